"""A labelled set of findings for secret scans, kept apart from the scanner: what services document about their keys, and
strings that only look like keys. The scanner's features know nothing of these forms; its forest learns from examples."""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass


@dataclass(frozen=True)
class Form:
    """What a finding looks like and the signs around it. {x:n} or {x:n-m} stand for so many signs of an alphabet, {w} for a word of the text."""

    label: int
    shape: str
    around: tuple[tuple[str, str], ...]


ALPHABETS = {
    "a": string.ascii_letters + string.digits,
    "b": string.ascii_letters + string.digits + "-_",
    "s": string.ascii_letters + string.digits + "+/",
    "h": "0123456789abcdef",
    "u": string.ascii_uppercase + "234567",
    "l": string.ascii_lowercase + string.digits,
    "d": string.digits,
    "p": string.ascii_letters + string.digits + "!@#$%&*?",
}
_ASSIGNED = (('token = "', '"'), ("password: ", ""), ("api_key=", ""), ("secret='", "'"), ("export AUTH_TOKEN=", ""), ('"client_secret": "', '",'), ("passwd=", ";"), ("access key ", ""), ('private_key: "', '"'))
_BARE = (("", ""), ("", ","), ("the key is ", "."), ("use ", ""), ("log in with ", ""), ('KEY="', '"'), ("credentials: ", ""), ("Authorization: Bearer ", ""))
_NAMED = (("commit ", ""), ("checksum ", ""), ("digest=", ""), ("revision ", ","), ("etag: ", ""), ("fixed in ", "."))
_PROSE = (("", ""), ("", ","), ("see ", ""), ("the ", "."), ("in ", " of"), ("(", ")"), ("name: ", ""), ('"', '"'), ("id = ", ""))

# Forms of keys as services document them (label 1) and of strings that are none (label 0).
FORMS = (
    Form(1, "ghp_{a:36}", _ASSIGNED + _BARE),
    Form(1, "{h:40}", _ASSIGNED),
    Form(1, "xoxb-{d:12}-{d:12}-{a:24}", _ASSIGNED + _BARE),
    Form(1, "AKIA{u:16}", _ASSIGNED + _BARE),
    Form(1, "{s:40}", _ASSIGNED + _BARE),
    Form(1, "AIza{b:35}", _ASSIGNED + _BARE),
    Form(1, "sk_live_{a:24}", _ASSIGNED + _BARE),
    Form(1, "npm_{a:36}", _ASSIGNED + _BARE),
    Form(1, "{h:32}", _ASSIGNED),
    Form(1, "{p:10-16}7a", _ASSIGNED),
    Form(1, "eyJ{b:30}.eyJ{b:60}.{b:43}", _ASSIGNED + _BARE),
    Form(1, "MII{s:61}", (("-----BEGIN PRIVATE KEY-----\n", "\n"), ("-----BEGIN RSA PRIVATE KEY-----\n", "\n"), ('private_key: "', "\n"))),
    Form(1, "{a:14-18}", (("postgres://app:", "@db.example.org/main"), ("mysql://root:", "@10.0.0.5/shop"), ("amqp://svc:", "@queue.example.net"))),
    Form(1, "glpat-{b:20}", _ASSIGNED + _BARE),
    Form(1, "{h:64}", _ASSIGNED),
    Form(1, "SG.{b:22}.{b:43}", _ASSIGNED + _BARE),
    Form(1, "{l:24-32}", _ASSIGNED),
    Form(1, "{b:43}", _ASSIGNED + _BARE),
    Form(1, "AccountKey={s:86}==", (("DefaultEndpointsProtocol=https;", ""), ("", ";EndpointSuffix=core.example.net"))),
    Form(1, "{a:20-40}", _ASSIGNED + _BARE[2:]),
    Form(0, "{h:40}", _NAMED + _PROSE[:1]),
    Form(0, "{h:64}", (("sha256:", ""), ("digest ", ""), ("image@sha256:", ""), ("SHA-256 ", ""), ("checksum: ", ""))),
    Form(0, "{h:32}", (("md5 ", ""), ("md5sum: ", ""), ('ETag: "', '"'), ("https://cdn.example.com/", "/main.js"), ("checksum=", ""))),
    Form(0, "{h:8}-{h:4}-{h:4}-{h:4}-{h:12}", _PROSE + (("uuid: ", ""), ("request ", ""))),
    Form(0, "{d:16}", _PROSE),
    Form(0, "{d:16-22}", _PROSE),
    Form(0, "{w}.{d:2}@{w}{d:1}.example.com", _PROSE + (("mailto:", ""),)),
    Form(0, "{w}{d:2}@{w}.org", _PROSE),
    Form(0, "{w}-{w}-{w}-{d:3}", _PROSE + (("https://example.org/", "/index.html"),)),
    Form(0, "{w}/{w}/{w}-{d:2}.html", (("https://example.org/", ""), ('href="', '"'))),
    Form(0, "{w}_{w}_v{d:1}.txt", _PROSE),
    Form(0, "{w}-{w}_{d:4}.tar.gz", _PROSE),
    Form(0, "{w}{w}{w}{w}{w}", _PROSE),
    Form(0, "{w}{w}{w}{w}", _PROSE),
    Form(0, "{W}{W}{W}Test{d:1}", _PROSE),
    Form(0, "get{W}{W}By{W}{d:1}", _PROSE),
    Form(0, "2{d:3}-0{d:1}-1{d:1}T1{d:1}", _PROSE),
    Form(0, "v{d:1}.{d:2}.{d:1}-rc{d:1}", _PROSE),
    Form(0, "sha512-{s:86}==", (('integrity="', '"'),)),
    Form(0, "sha384-{s:64}", (('integrity="', '"'), ("integrity ", ""))),
    Form(0, "iVBORw0KGgo{s:60}", (("data:image/png;base64,", ""), ('src="data:image/png;base64,', '"'))),
    Form(0, "R0lGODlh{s:60}", (("data:image/gif;base64,", ""), ("url(data:image/gif;base64,", ")"))),
    Form(0, "10.{d:4}/{w}.{d:4}", (("doi:", ""), ("https://doi.org/", ""))),
    Form(0, "{w}{w}###", _PROSE),
)

_SPEC = re.compile(r"\{(\w)(?::(\d+)(?:-(\d+))?)?\}")


def example(forms: tuple[Form, ...], seed: str, words: list[str]) -> tuple[str, str, str]:
    """(signs before, finding, signs after) of one of ``forms``, by the seed alone and the words it may use."""
    draw = random.Random(seed)
    form = draw.choice(forms)
    words = words or ["lorem", "ipsum", "dolor", "amet"]

    def filled(m: re.Match) -> str:
        kind, low, high = m[1], m[2], m[3]
        if kind in "wW":
            word = draw.choice(words).lower()
            return word.capitalize() if kind == "W" else word
        return "".join(draw.choices(ALPHABETS[kind], k=draw.randint(int(low), int(high or low))))

    before, after = draw.choice(form.around)
    return before, _SPEC.sub(filled, form.shape), after
