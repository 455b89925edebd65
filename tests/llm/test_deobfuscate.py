"""Base spans against the plain patterns, disguises against planted ones, offsets against the source."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from conftest import SF
from keepwell.llm.deobfuscate import ENDINGS, KINDS, PROSE, PROSE_AFTER, SURE, UNSURE, at_signs, detect, disguised, find_identifiers, luhn, rewrite
from keepwell.llm.queries import QUERIES

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return [True, all(int(p) <= 255 for p in found.split(".")) if kind == 1 else True,
            14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(k, m[0]))


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a1.@-+ (25)4Z\n٣é"), max_size=40))
def test_base_equals_patterns(text):
    assert detect(text) == plain(text)


def test_base_on_fixed_texts():
    text = "a@b.c@d.e x@y.zz. 1.2.3.4.5.6.7.8 999.1.1.1 4242 4242 4242 4242 +1 (555) 123-4567, 4111-1111-1111-1111-9"
    assert detect(text) == plain(text) and len(detect(text)) >= 5
    assert detect("7" * 200_000 + "a" * 200_000 + "@") == []


@pytest.mark.parametrize("text,kind,normal", [
    ("write to john.doe (at) mail (dot) example (dot) com today", 0, "john.doe@mail.example.com"),
    ("write to john [at] mail.example.com.", 0, "john@mail.example.com"),
    ("write to john at mail dot com now", 0, "john@mail.com"),
    ("JOHN AT MAIL DOT COM", 0, "JOHN@MAIL.COM"),
    ("john{at}mail[dot]org", 0, "john@mail.org"),
    ("x john-at-mail-dot-com y", 0, "john@mail.com"),
    ("john_AT_mail_DOT_com", 0, "john@mail.com"),
    ("john @ mail . com", 0, "john@mail.com"),
    ("john[@]mail[.]com", 0, "john@mail.com"),
    ("server 192[.]168[.]1[.]20", 1, "192.168.1.20"),
    ("4 two 4 two 4 two 4 two 4 two 4 two 4 two 4 two", 2, "4 2 4 2 4 2 4 2 4 2 4 2 4 2 4 2"),
    ("juan arroba correo punto es", 0, "juan@correo.es"),
    ("x jоhn@exаmple.com y", 0, "john@example.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", 0, "john@example.com"),
    ("jo​hn@exam­ple.c‍om", 0, "john@example.com"),
    ("call plus one five five five one two three four five six seven.", 3, "+15551234567"),
    ("card four two four two four two four two four two four two four two four two end", 2, "4242424242424242"),
    ("cuatro dos cuatro dos cuatro dos cuatro dos cuatro dos cuatro dos cuatro dos cuatro dos", 2, "4242424242424242"),
    ("at 192 dot 168 dot 1 dot 20 is", 1, "192.168.1.20"),
    ("one nine two dot one six eight dot one dot two zero", 1, "192.168.1.20"),
    ("card ４２４２ ４２４２ ４２４２ ４２４２", 2, "4242 4242 4242 4242"),
    ("+٤٩ ١٥١ ٢٣٤٥٦٧٨٩", 3, "+49 151 23456789"),
])
def test_disguises_are_mapped_back(text, kind, normal):
    found = [x for x in disguised(text, detect(text)) if x[0][1] == kind]
    assert [n for _, n in found] == [normal]
    (start, _, end), _ = found[0]
    assert not text[start].isspace() and not text[end - 1].isspace()
    assert [n for (a, k, b), n in disguised("é​ " + text, detect("é​ " + text)) if (a, b) == (start + 3, end + 3)] == [normal]


@pytest.mark.parametrize("text", [
    "meet me at example.com today", "look at the dot on it", "one two three four", "mail x@y.com at noon", "it is at that point in time",
    "He was at home dot", "un deux trois points", "un chat et six chiens", "state-of-the-art look-at-this", "a . b . c @ home", "(at) the (dot)", "Él está más 5 cosas", "at at at dot dot dot", "1.2.3.4 x@y.zz"])
def test_plain_prose_is_left_alone(text):
    assert disguised(text, detect(text)) == []


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["one", "nine ", " at ", "(dot)", " dot ", "a", "@", ".", "é", "​", "о", " ", "+", "plus 1", "4", "\x00"]), max_size=14).map("".join))
def test_spans_lie_in_the_source(text):
    base = detect(text)
    tape = rewrite(text)
    if tape.start is not None:
        assert len(tape.start) == len(tape.end) == len(tape.text)
        assert all(a < b for a, b in zip(tape.start, tape.end)) and (tape.start[1:] >= tape.start[:-1]).all()
    for (start, kind, end), _ in disguised(text, base):
        assert 0 <= start < end <= len(text) and not any(k == kind and s < end and start < e for s, k, e in base)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_deobfuscate"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(",")) and len([x for x in r.spans.split(",") if x]) == len(spans) + r.n_added


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, "", 5), (2, "x@y.zz", 5), (2, "x@y.zz", 5), (None, "a (at) b.cd " + "word " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = find_identifiers(docs, "text")
    assert out.columns == ["doc_id", "text", "spans"]
    got = [[(s.kind, s.start, s.end, s.added) for s in r.spans] for r in out.collect()]
    assert got == [[], [], [("email", 0, 6, False)], [("email", 0, 6, False)], [("email", 0, 11, True)]]
    assert find_identifiers(docs.limit(0), "text").collect() == []


@pytest.mark.parametrize("text,normal", [
    ("jane at mail dot in", "jane@mail.in"), ("maria arroba correo punto cl", "maria@correo.cl"), ("john_at_mail_dot_ai", "john@mail.ai"),
    ("x jane-at-mail-dot-xyz y", "jane@mail.xyz"), ("jane at mail dot co dot nz today", "jane@mail.co.nz"), ("jane @ mail . app", "jane@mail.app"),
    ("juan arroba correo point kr", "juan@correo.kr"), ("JANE AT MAIL DOT AU", "JANE@MAIL.AU"), ("jane at mail dot photography.", "jane@mail.photography"),
    ("write to jane at mail.example dot cz now", "jane@mail.example.cz"), ("jane at mail[.]ie", "jane@mail.ie"), ("jane at the dot com", "jane@the.com")])
def test_any_ending_when_at_and_dot_are_disguised(text, normal):
    found = disguised(text, detect(text))
    assert [n for _, n in found] == [normal]
    (start, _, end), _ = found[0]
    assert text[start:end].lower().startswith(normal[:4].lower()) and text[:end].lower().endswith(normal.rsplit(".", 1)[1].lower())


@pytest.mark.parametrize("text", [
    "look at the dot in it", "staring at polka dot dresses", "we met at home . then we left", "a party @ home . Then we left", "we were at work dot and then",
    "stop at this point in the text", "she stood at one dot of ink", "come at nine dot dot dot", "at any point we look at his dot art"])
def test_prose_with_at_and_dot_is_left_alone(text):
    assert disguised(text, detect(text)) == []


def test_long_chains_take_linear_time():
    text = "x at " + "a dot " * 100_000 + "1"
    assert disguised(text, detect(text)) == []


def test_chains_of_signs_take_linear_time():
    for part in ("-at-x", "at-", "a-at-b(dot)", "-at-", "a at b dot ", "a at ", "x_at_", "a(at)", "a at b.", "a-at-b\x00"):
        text = "x" + part * (1_000_000 // len(part))
        start = time.perf_counter()
        disguised(text, detect(text))
        assert time.perf_counter() - start < 20, part


def by_patterns(text):
    """The signs by one backtracking pattern, which looks along the whole chain at every sign."""
    dots, label = f"[.{SURE}{UNSURE}]", "[A-Za-z0-9-]+"
    labels, ending, after = f"{label}(?:{dots}{label})*?", "[A-Za-z]{2,24}(?![A-Za-z0-9-])", "(?![A-Za-z0-9-])"
    bare = lambda words: rf"(?<=[\w%+-])\s+(?:{words})\s+(?=[\w-])"
    tied = "(?<=[A-Za-z0-9])(?:_(?:at|arroba)_|-(?:at|arroba)-)(?=[A-Za-z0-9])"
    pattern = re.compile(
        rf"(?<!\s)\s*[(\[{{<]\s*(?:at|arroba|@)\s*[)\]}}>]\s*(?={label}{dots})"
        rf"|(?:{bare('at|arroba|@')}|{tied})(?={labels}[{SURE}{UNSURE}](?:{'|'.join(ENDINGS)}){after})"
        rf"|{bare('arroba|@')}(?={labels}(?:{SURE}|{UNSURE}(?!(?-i:[A-Z][a-z]))){ending})"
        rf"|{tied}(?={labels}{SURE}{ending})"
        rf"|{bare('at')}(?!(?:{'|'.join(PROSE)})[{SURE}{UNSURE}])(?={labels}{SURE}(?!(?:{'|'.join(PROSE_AFTER)}){after}){ending})", re.I)
    return [m.span() for m in pattern.finditer(text)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bo", "x-", "at", " at ", " @ ", " arroba ", "-at-", "_at_", "(at)", " ", ".", SURE, UNSURE, "com", "the", "and", "point", "Abc", "7", "é", "_"]),
                max_size=16).map("".join))
def test_signs_equal_those_of_the_patterns(text):
    assert list(at_signs(text)) == by_patterns(text)


def test_recall_of_planted_disguises():
    """Every way of writing at and dot that the tables name, in the middle of prose."""
    ats = [" (at) ", "[at]", " at ", "-at-", "_at_", " arroba ", "{@}", " @ "]
    dots = [" (dot) ", "[.]", " dot ", " punto ", "-dot-", "_dot_"]
    cases = [(f"please write to jane{a}mail{d}com and wait", "jane@mail.com") for a in ats for d in dots]
    cases += [("call plus four nine one five one two three four five six seven", "+49151234567"), ("host one nine two dot 168 dot 0 dot 1 is down", "192.168.0.1")]
    caught = [wanted in [n for _, n in disguised(text, detect(text))] for text, wanted in cases]
    assert sum(caught) / len(cases) >= 0.95, [c for c, ok in zip(cases, caught) if not ok]
