"""What line dedup leaves in the shared folder while its lazy result is read."""

from pathlib import Path

from tallyframe.llm import lines
from tallyframe.llm._common import shared_dir


def test_texts_of_lines_do_not_stay_on_disk(spark):
    """The result reads ids, places, hashes and classes; tables with the lines' texts are deleted before it is returned."""
    root = Path(shared_dir(spark).removeprefix("file:")) / "tallyframe"
    before = set(root.glob("*/*"))
    texts = ["the quick brown fox jumps over it\nanother line of some words", "the quick brown fox jumped over it\nshort", "another line of some words\nalone among the many lines"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lines.deduplicate(df)
    kept = [spark.read.parquet(str(p)) for p in set(root.glob("*/*")) - before if any(p.glob("*.parquet"))]
    assert kept and not any({"line", "text"} & set(t.columns) for t in kept)
    assert {(r.doc_id, r.n_lines, r.n_removed, r.n_near) for r in out.collect()} == {(0, 2, 0, 0), (1, 2, 1, 1), (2, 2, 1, 0)}
