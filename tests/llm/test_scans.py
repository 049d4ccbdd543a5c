"""Secret and personal-data scans against the contract's patterns, and the added methods."""
import hashlib
import re
import time

import pytest
from llm_tables import frame  # noqa: F401

from shelfcast.llm import common, pii, secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
HARD = [
    None, "", "password: token=abcdefghijklmnop", "secret: password: abcdefghijklmn", "TOKEN='abcdefghijkl'", "api_key=abcdefghijk",
    "AKIA" + "Z" * 14, "AKIA" + "Z" * 13, "AKIAAKIA" + "Z" * 12, "x" + "0f" * 8 + "y", "0f" * 7 + "0 " + "a" * 40, "ſecret=abcdefghijklmnop",
    "a@b.c a@@b.co x@y .@z.zz a@b.c@d.e", "1.2.3.4.5 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000",
    "+1 (706) 555-3138 +12 +1234567890123456 +49.30.1234567", "a%b+c@x-y.co-m.", "é@b.co ä1.2.3.4",
]


def base_secrets(text):
    text = text or ""
    found = [("assign", m) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 12]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def luhn(digits):
    values = [int(c) for c in digits[::-1]]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def base_personal(text):
    text = text or ""
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 12 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.mark.parametrize("module,plain,query", [
    (secrets, base_secrets, secrets.secret_digests), (pii, base_personal, pii.personal_data_digests)])
def test_base_spans_of_whole_tables(spark, folder, frame, module, plain, query):
    for text in HARD:
        assert [x[:3] for x in module.scan_text(text) if x[-1]] == plain(text), text
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = query(spark, folder).collect()
    assert len(rows) == len(texts)
    kinds = module.KINDS[:4] if module is pii else module.KINDS[:3]
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


@pytest.mark.parametrize("scan", [secrets.scan_secrets, pii.scan_personal_data])
def test_rows_stay(frame, scan):
    rows = [(1, "token=abcdefghijkl a@b.co"), (1, "token=abcdefghijkl a@b.co"), (None, None), (2, ""), (3, "word " * 300_000 + "token=abcdefghijkl a@b.co")]
    got = scan(frame(rows)).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 1)]
    assert scan(frame([])).collect() == []


def values(text, spans):
    return [(x[0], text[x[1]:x[2]]) for x in spans if not x[-1]]


def test_assignments_and_constants():
    text = 'part = "aB3dE5fG7hJ9"\npassword = part + "!k9"\nwidth = "aB3dE5fG7hJ9"\nclient_pwd => q9!w8$e7r6\n'
    assert values(text, secrets.scan_text(text)) == [("constant", "aB3dE5fG7hJ9"), ("constant", "!k9"), ("literal", "q9!w8$e7r6")]
    assert secrets.scan_text('title = "a long enough value 1"') == []
    assert secrets.name_weight("dbPassword") == 1.0 and secrets.name_weight("monkey") == 0


@pytest.mark.parametrize("name", [*secrets.NAME_WEIGHTS, "encryption_key", "signing_key", "ssh_key", "requestSignature", "pwd_salt"])
def test_every_listed_name_can_mark(name):
    for value in ("q9Zt+Lw4/RxVb7Nc2HsKd8Yf3MgPj5Ua", "aB3$dE5!", "Xk+QzRtLpWvBnMcJ=="):
        found = values(f'{name} = "{value}"', secrets.scan_text(f'{name} = "{value}"'))
        assert found == [("literal", value)] or any(x[-1] for x in secrets.scan_text(f'{name} = "{value}"')), (name, value)


def test_words_under_strong_and_weak_names():
    for text in ('pwd = "SuperSecretPhrase"', "pwd=SuperSecretPhrase\n"):
        assert values(text, secrets.scan_text(text)) == [("literal", "SuperSecretPhrase")]
    for text in ('key = "user.name"', "key: well-known", 'key = "Content-Type"', "sort(key=operator.itemgetter)", "pwd: required",
                 'key = "press any of these!"', "key = 20240101", 'pwd = "aaaaaaaaaaaa"', 'monkey = "q9Zt+Lw4/RxVb7Nc2HsKd8Yf"'):
        assert secrets.scan_text(text) == [], text


@pytest.mark.parametrize("text,kind,span", [
    ("write to ann dot lee at example dot com today", "email", "ann dot lee at example dot com"),
    ("ann [at] example (dot) org", "email", "ann [at] example (dot) org"),
    ("ann＠example．com", "email", "ann＠example．com"),
    ("аnn@ехample.com", "email", "аnn@ехample.com"),
    ("call plus one seven zero six five five five three one three eight now", "phone", "plus one seven zero six five five five three one three eight"),
    ("card ４111 1111 1111 1１11", "card", "４111 1111 1111 1１11"),
])
def test_disguises(text, kind, span):
    assert (kind, span) in values(text, pii.scan_text(text))
    assert span not in pii.redact_text(text) and f"[{kind}]" in pii.redact_text(text)


@pytest.mark.parametrize("span", [
    "ann (at) example dot com", "ann at example [dot] com", "ann@example dot com", "ann dot lee (at) mail dot example [dot] org",
    "ann at mail [dot] example dot com", "ann {at} example.co dot uk", "x at mail dot xyz", "x at mail dot museum", "ann (at) host dot intranet",
    "ann @ example dot com", "ann at mail dot example.com"])
def test_mixed_signs(span):
    for text in (f"so {span}, today", span, f"look at this dot {span} or call"):
        found = [x for x in values(text, pii.scan_text(text)) if x[0] == "email"]
        assert len(found) == 1 and found[0][1].endswith(span), (text, found)
        assert span.split()[-1] not in pii.redact_text(text)


@pytest.mark.parametrize("text,kind,span", [
    ("at 192 dot 168 dot 10 dot 7 now", "ip", "192 dot 168 dot 10 dot 7"),
    ("at 192.168 dot 10 [dot] 7 now", "ip", "192.168 dot 10 [dot] 7"),
    ("tel seven zero six - five five five - three one three eight.", "phone", "seven zero six - five five five - three one three eight"),
    ("tel seven zero six\nfive five five\r\nthree one three eight.", "phone", "seven zero six\nfive five five\r\nthree one three eight"),
    ("tel (seven zero six) five five five - three one three eight.", "phone", "seven zero six) five five five - three one three eight"),
    ("tel plus one (seven zero six) - five five five, three one three eight.", "phone",
     "plus one (seven zero six) - five five five, three one three eight"),
])
def test_dotted_numbers_and_broken_digits(text, kind, span):
    assert (kind, span) in values(text, pii.scan_text(text))
    assert span not in pii.redact_text(text) and f"[{kind}]" in pii.redact_text(text)


@pytest.mark.parametrize("text", ["visit us at example.com today", "look at this dot here", "300 dot 1 dot 2 dot 3", "meet at noon dot then go",
                                  "one\n\ntwo - (three)", "look at the dot near a line"])
def test_ordinary_signs_are_left_alone(text):
    assert pii.scan_text(text) == []


@pytest.mark.parametrize("text", ["look at this dot on the map", "one two three", "un un un un un un un un un un", "Größe éèê ñ ß", "meet at noon"])
def test_plain_text_is_left_alone(text):
    assert pii.scan_text(text) == [] and pii.redact_text(text) == text


def test_redacted_table_keeps_columns(frame):
    df = frame([(1, "mail a@b.co", 11), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact(df, length_col="n_chars").collect()}
    assert got[1]["text"] == "mail [email]" and got[1]["n_chars"] == 12 and got[1]["spans"] == "clash"
    assert got[2]["text"] is None and got[2]["n_chars"] is None and got[3]["text"] == ""


# ---------------------------------------------------------------- long texts and look-alikes

LONG = {
    "doubling": 'a0 = "aB3dE5fG7hJ9"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(60)) + "password = a60\n",
    "empty doubling": 'a0 = ""\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(60)) + "password = a60\n",
    "growing": 'a = "q9"\n' + "".join(f'a = a + "{(i * 7919) % 99991:05x}"\n' for i in range(20_000)) + "password = a\n",
    "growing secrets": 'a = "q9"\n' + 'password = a + "x7"\n' * 20_000,
    "pairs": "".join(f"k{i}=v{i}&" for i in range(90_000)),
    "secret pairs": "".join(f"token{i}=v{i}&" for i in range(20_000)),
    "tabs": "(" + "\t" * 1_000_000 + "x",
    "tabs and signs": "ann" + "\t" * 300_000 + "(at)" + "\t" * 300_000 + "example.com " + " " * 300_000 + "dot",
    "addresses": "ann@example.com \u0430nn@example.com (x) " * 50_000,
    "digits": "1" * 500_000 + "a" + " one" * 100_000,
    "quotes": 'x = "' * 100_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
@pytest.mark.parametrize("scan", [secrets.scan_text, pii.scan_text])
def test_long_texts_take_time_in_proportion(scan, name):
    def seconds(text):
        begin = time.process_time()
        scan(text)
        return time.process_time() - begin

    assert seconds(LONG[name]) < 1.5 + 6e-6 * len(LONG[name])


def test_chained_constants_keep_their_literals():
    for text in (LONG["doubling"], 'a = "aB3dE5fG7hJ9"\nb = a\nc = b\npassword = c\n'):
        assert values(text, secrets.scan_text(text)) == [("constant", "aB3dE5fG7hJ9")]
    found = values(LONG["growing"], secrets.scan_text(LONG["growing"]))
    assert len(found) == 20_001 and {len(x[1]) for x in found} == {2, 5}
    assert secrets.scan_text(LONG["empty doubling"]) == []


@pytest.mark.parametrize("place", range(len("john.doe@example.com")))
def test_look_alikes_at_every_place(place):
    swaps = {"o": "\u043e", "e": "\u0435", "a": "\u0430", "x": "\u0445", "p": "\u0440", "c": "\u0441", "j": "\u0458", "d": "\u0501", ".": "\uff0e", "@": "\uff20"}
    plain = "john.doe@example.com"
    if plain[place] not in swaps:
        return
    hidden = plain[:place] + swaps[plain[place]] + plain[place + 1:]
    for text in (hidden, f"write to {hidden}, or call"):
        at = text.index(hidden)
        assert ("email", at, at + len(hidden)) in [x[:3] for x in pii.scan_text(text)]
        assert pii.redact_text(text) == text.replace(hidden, "[email]")


@pytest.mark.parametrize("span", ["ann @ example.com", "ann&#64;example.com", "ann&commat;example&#x2e;com", "ann -at- example -dot- com", "ann (at) example.com"])
def test_spaced_hyphenated_and_coded_signs(span):
    for text in (span, f"so {span}, today"):
        assert pii.redact_text(text) == text.replace(span, "[email]")


@pytest.mark.parametrize("text", ["five apples @ 3.99 each", "look at example.com", "stay-at-home.org moms", "look -at- me"])
def test_ordinary_at_signs(text):
    assert pii.redact_text(text) == text


def test_stretches():
    spans = common.Stretches([(5, 9), (0, 20), (30, 31)])
    assert spans.hold(6, 20) and not spans.hold(6, 21) and spans.hold(30, 31) and not spans.hold(25, 26)
    assert sorted(spans.touched(8, 31)) == [(0, 20), (5, 9), (30, 31)] and spans.touched(20, 30) == []
