import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import pii

from .helpers import documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda s: re.sub("[^0-9]", "", s)


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a@.-12 +50()%b٣é")), max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


DISGUISED = [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("john (at) mail dot example dot com please", "email", "john (at) mail dot example dot com"),
    ("write to jane at example dot org today", "email", "jane at example dot org"),
    ("joe AT gmail DOT com", "email", "joe AT gmail DOT com"),
    ("john_at_example_dot_com", "email", "john_at_example_dot_com"),
    ("ｊｏｈｎ＠example.com", "email", "ｊｏｈｎ＠example.com"),
    ("jоhn@exаmple.com see", "email", "jоhn@exаmple.com"),
    ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
    ("call plus four nine one five one two three four five six seven eight now", "phone", "plus four nine one five one two three four five six seven eight"),
    ("number five five five one two three four five six seven ok", "phone", "five five five one two three four five six seven"),
    ("+１ (４１５) ５５５-２６７１", "phone", "+１ (４１５) ５５５-２６７１"),
    ("host 192[.]168[.]1[.]10 up", "ip", "192[.]168[.]1[.]10"),
    ("host 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
    ("pay four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
]


@pytest.mark.parametrize("text, kind, span", DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, span):
    for before in ("", "é" * 300 + " ", "plain words " * 40):
        base, added = pii.find_spans(before + text + " end")
        found = [(k, (before + text)[a:b]) for k, a, b in base + added]
        assert (kind, span) in found


@pytest.mark.parametrize("text", ["look at this. And the dot is at home. at noon", "(at) the and. (a) list", "un un un un un un un un un un un", "He is at the at. Dot the end", "one two three, go", "a. b. c. d", "Él está en el punto de la calle", "5 at 6 and 7"])
def test_clean_prose_is_left_alone(text):
    assert pii.find_spans(text) == ([], [])


def test_documents(spark):
    rows = [(1, "a@b.com and +49 (151) 234-5678, card 4111 1111 1111 1111, ip 10.0.0.1 " + "x" * 200_000), (2, None), (3, ""), (None, "z@y.org"), (4, "z@y.org"), (4, "z@y.org"), (5, "z [at] y [dot] org")]
    got = {(r.doc_id, r.n_email): r for r in pii.find_documents(documents(spark, rows)).collect()}
    one = got[1, 1]
    assert (one.n_ip, one.n_card, one.n_phone, one.n_added) == (1, 1, 1, 0)
    assert one.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(brute(rows[0][1]), key=lambda s: (pii.KINDS.index(s[0]), s[1])))
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    assert got[2, 0].spans == got[3, 0].spans == ""
    assert (got[5, 0].spans, got[5, 0].n_added) == ("email:0:18", 1)
    assert (None, 1) in got
    assert pii.find_documents(documents(spark, rows)).count() == 7
    assert pii.find_documents(documents(spark, [])).count() == 0


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "@" * 100_000, "one " * 50_000, "a at b dot " * 20_000):
        pii.find_spans(text)


FRAGMENTS = [
    ("jоhn@example.com see", "email", "jоhn@example.com"),
    ("jo​hn@example.com see", "email", "jo​hn@example.com"),
    ("write a@mail.exаmple.com", "email", "a@mail.exаmple.com"),
    ("call +49 1512345 67O8 now", "phone", "+49 1512345 67O8"),
]


@pytest.mark.parametrize("text, kind, span", FRAGMENTS)
def test_spans_beyond_a_base_span_are_added(text, kind, span):
    for before in ("", "plain words " * 40):
        base, added = pii.find_spans(before + text)
        assert base == pii.base_spans(before + text) and base
        assert [(k, (before + text)[a:b]) for k, a, b in added] == [(kind, span)]


NAMED = ["anna at firma dot se", "anna at firma.no", "anna [at] firma dot pl", "jan@firma dot dk", "anna at firma punkt ch dot online", "anna_at_firma_dot_xyz"]


@pytest.mark.parametrize("text", NAMED)
def test_named_signs_take_any_last_label(text):
    assert ("email", 5, 5 + len(text)) in pii.find_spans("mail " + text + " now")[1]


@pytest.mark.parametrize("text", ["at this point he left", "look at the dot on it", "at what point did they", "she @ home . Then"])
def test_prose_with_named_signs_is_left_alone(text):
    assert pii.find_spans("we " + text) == ([], [])


def test_named_signs_stay_linear():
    for text in ("a at " + "b-" * 20_000, "a@" + "b." * 20_000, "a at b dot " * 5_000):
        pii.find_spans(text)


def test_texts_without_spaces_cost_what_their_length_costs():
    for part in ("中文" * 20 + "jоhn＠exаmple。com" + "字" * 10, "a[at]b", "7o", "one two "):
        began = time.perf_counter()
        pii.find_spans(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 5


def test_segments_find_what_whole_windows_find(monkeypatch):
    part = "中文" * 9 + "jоhn＠exаmple。com" + "字" * 11 + " call one two three four five six seven eight nine "
    whole = pii.find_spans(part * 40)
    assert len(whole[1]) == 80
    for size in (1000, 1777):
        monkeypatch.setattr(pii, "SEGMENT", size)
        assert pii.find_spans(part * 40) == whole
