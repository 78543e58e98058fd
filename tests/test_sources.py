"""Raw files by header, digests of files of any size, profiles by the feature table's expressions, thresholds by range."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql.types import StructField, StructType

from tallyframe.operators import contract, features, metrics
from tallyframe.plans import queries
from tallyframe.sources import inventory, scratch

SF = "/root/testdata/sf0.001"


def test_files_are_united_by_column_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,\n")
    (tmp_path / "b.csv").write_text('"y","z","x"\r\n5,6,4\r\n')
    (tmp_path / "c.csv").write_text("x,y\n7,8\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfx,y\n9,10\n")
    raw = inventory.read_raw(spark, [str(tmp_path)], "e", key="x")
    got = sorted(map(tuple, raw.select("_bronze_source_file", "x", "y", "z").collect()))
    assert got == [("a.csv", "1", "2", None), ("a.csv", "3", None, None), ("b.csv", "4", "5", "6"), ("bom.csv", "9", "10", None), ("c.csv", "7", "8", None)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no rows"):
        inventory.read_raw(spark, [str(tmp_path / "none")], "e")


@pytest.mark.parametrize("whole", [inventory.WHOLE, 3, 0])
def test_digests_in_one_piece_or_as_streams(spark, tmp_path, whole):
    texts = {"a": b"", "b": b"abc", "c": b"x" * 20_000_000, "d e": b"\x00\xff" * 9}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    got = {r.file_name: (r.size, r.sha256) for r in inventory.file_digests(spark, str(tmp_path), whole).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in texts.items() if v}
    assert got["c"][0] == 20_000_000


def test_a_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
        f.seek(2 << 30)
        f.write(b"mark")
    with open(tmp_path / "large", "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    listed = spark.createDataFrame([("large", 7), ("gone", 1)], "file_name string, expected_rows long")
    assert [tuple(r) for r in inventory.manifest(spark, str(tmp_path), listed).collect()] == [("large", 7, 3 << 30, want)]


def test_profiles_have_the_columns_of_the_feature_table(spark):
    gold = queries._gold(spark, SF).where("age_years is not null").cache()
    served = features.served(gold.select("bene_id", "year", *features.RAW_FIELDS))
    typed = [features.contract(df, ["bene_id", "year", *contract.ORDER], contract.INTS, contract.LONGS) for df in (gold, served)]
    kinds = dict(typed[0].dtypes)
    assert kinds == dict(typed[1].dtypes) and all(kinds[c] == "int" for c in contract.INTS if c in kinds) and all(kinds[c] == "bigint" for c in contract.LONGS)
    assert {kinds[c] for c in contract.NUMERIC if c not in contract.INTS and c not in contract.LONGS} == {"double"}
    assert typed[0].exceptAll(typed[1]).count() == typed[1].exceptAll(typed[0]).count() == 0 and gold.count() > 100


def test_profiles_without_age_have_the_middle_of_their_band(spark):
    gold = queries._gold(spark, SF).select("bene_id", "year", *features.RAW_FIELDS).limit(6).collect()
    bands = ["under_65", "65_74", "75_84", "85_plus", "unknown", None]
    rows = [r.asDict() | {"age_years": None, "age_band": b, "annual_cost_year_decile": 10, "current_year_high_cost_indicator": 0} for r, b in zip(gold, bands, strict=True)]
    schema = StructType([StructField(f.name, f.dataType) for f in queries._gold(spark, SF).select("bene_id", "year", *features.RAW_FIELDS).schema])
    got = features.served(spark.createDataFrame([[r[f.name] for f in schema] for r in rows], schema)).select("age_years_imputed", "age_5yr_band", "age_band", "age_missing_flag", "age_over_75", "current_year_high_cost_indicator").collect()
    assert [tuple(r) for r in got] == [(60, "under_65", "under_65", 1, 0, 1), (70, "65_74", "65_74", 1, 0, 1), (80, "75_84", "75_84", 1, 5, 1), (88, "85_plus", "85_plus", 1, 13, 1), (75, "unknown", "unknown", 1, 0, 1), (75, "unknown", "unknown", 1, 0, 1)]


def test_thresholds_by_range_are_the_slow_ones(spark):
    r = np.random.default_rng(6)
    data = {g: (r.random(n).round(2), (r.random(n) < 0.3).astype(float)) for g, n in (("a", 1), ("b", 300), ("c", 40))}
    rows = [(g, float(p), float(y)) for g, (ps, ys) in data.items() for p, y in zip(ps, ys, strict=True)]
    df = spark.createDataFrame(rows, "g string, predicted_probability double, label double")
    got = {x.g: x for x in metrics.best_of_thresholds(df, ["g"], metrics.fine_thresholds(df, ["g"])).collect()}
    for g, (p, y) in data.items():
        best = (-1.0, None)
        for t in np.unique(np.r_[np.arange(1, 100) / 100, np.quantile(p, np.arange(101) / 100)]):
            said = p >= t
            f1 = 2 * y[said].sum() / (said.sum() + y.sum()) if said.sum() + y.sum() else 0.0
            best = (f1, t) if f1 > best[0] + 1e-12 else best
        assert got[g].f1_score == pytest.approx(best[0]) and got[g].decision_threshold == pytest.approx(best[1])
    assert metrics.best_of_thresholds(df.limit(0), ["g"], metrics.fine_thresholds(df.limit(0), ["g"])).count() == 0


def test_years_of_files_are_those_of_the_last_entry_in_their_names(spark, tmp_path):
    names = ["b_2008_2009.csv", "b_2009.csv", "x.csv", "b_2008.csv", "aaaa"]
    for n in names:
        (tmp_path / n).write_text("k\n1\n")
    rows = [(0, "b_2008", "e", 2008), (1, "2009.csv", "e", 2009), (2, "b_2009", "e", 2010), (3, None, "e", 2011), (4, "b_2008.csv.longer.than.any.name", "e", 2012), (5, "aa", "e", 2013), (6, "x", "other", 2014), (7, "2008.csv", "e", None)]
    listed = spark.createDataFrame(rows, "position int, file_name string, entity string, year int")

    def slow(name: str) -> set:
        held = [(at, year) for at, part, entity, year in rows if entity == "e" and part is not None and part in name]
        return {(name, max(held)[1])} if held else set()

    got = inventory.file_years(spark, [str(tmp_path)], "e", listed, ("e",))
    assert {(r.file, r.year) for r in got.collect()} == set().union(*map(slow, names))
    every = listed.unionByName(spark.createDataFrame([(9, "", "e", 2015)], listed.schema))
    assert {r.year for r in inventory.file_years(spark, [str(tmp_path)], "e", every, ("e",)).collect()} == {2015}
    assert inventory.file_years(spark, [str(tmp_path)], "e", listed.limit(0), ("e",)).count() == 0
    assert inventory.file_years(spark, [str(tmp_path)], "e", listed, ()).count() == 0


def test_years_are_joined_by_a_shuffle_beyond_the_bound(spark, tmp_path, monkeypatch):
    (tmp_path / "b_2009.csv").write_text("k\n1\n2\n")
    (tmp_path / "c.csv").write_text("k\n3\n")
    listed = spark.createDataFrame([(0, "2009", "e", 2009)], "position int, file_name string, entity string, year int")
    both = []
    for bound in (inventory.BROADCAST, 0):
        monkeypatch.setattr(inventory, "BROADCAST", bound)
        both.append(sorted((r.k, r._bronze_source_year) for r in inventory.read_raw(spark, [str(tmp_path)], "e", listed, yearly=("e",)).collect()))
    assert both[0] == both[1] == [("1", 2009), ("2", 2009), ("3", None)]


def test_scratch_of_an_application_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    there = lambda table: Path(table.saved_at).exists()
    kept, gone = scratch.saved(spark.range(5), "a"), scratch.saved(spark.range(5), "b")
    scratch.drop(gone)
    assert there(kept) and not there(gone) and kept.count() == 5
    scratch.clear(spark)
    assert not there(kept) and scratch.saved(spark.range(5), "c").count() == 5
