import dataclasses
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeflow.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (
                True,
                k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                14 <= len(digits) <= 19 and pii.luhn(digits),
                10 <= len(digits) <= 15,
            )[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="ab@.+-12 9()%\n05é", max_size=60), st.from_regex(r"(\+?[0-9]{1,4}[ .-]){3,8}[a-z]@b\.c", fullmatch=True)))
def test_base_is_the_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.train()


def without_skips(field):
    return dataclasses.replace(field, skip=np.zeros_like(field.skip))


def added(text, field):
    base, spans = pii.find(text, field)
    assert [x for x in spans if x in base] == base
    return [text[s:e] for s, k, e in spans if (s, k, e) not in base]


@pytest.mark.parametrize(
    ("text", "short"),
    [
        ("call +1 (988) 555-2485 now. " + "plain words " * 40 + "again (988) 555-2485 today in 2024", "(988) 555-2485"),
        ("write re.46@mail8.example.com or " + "more words " * 30 + "to re.46@mail8 again", "re.46@mail8"),
    ],
)
def test_what_a_short_form_repeats_decides(field, text, short):
    assert added(text, field) == [short]
    assert added(text, without_skips(field)) == []


def test_other_numbers_are_left_alone(field):
    for text in ("v2.0.1 in 2024, 12 of 300 at 10:30, abc123", "host 10.0.0.300 and 10.0.0.300 again", "part (988) 555-2485 alone"):
        assert added(text, field) == []


def figures(field, seed):
    """(right, wrong, missed) tokens of made documents that no base span has."""
    right = wrong = missed = 0
    for document in pii.training_documents(150, seed):
        text = " and so on. ".join(" ".join(w for w, _ in sentence) for sentence in document)
        base, spans = pii.find(text, field)
        new, at = [x for x in spans if x not in base], 0
        for word, y in (t for sentence in document for t in sentence):
            s = text.index(word, at)
            at = e = s + len(word)
            if any(x < e and z > s for x, _, z in base):
                continue
            kinds = [k + 1 for x, k, z in new if x < e and z > s]
            right += bool(kinds) and y in kinds
            wrong += bool(kinds) and y not in kinds
            missed += not kinds and y > 0
    return right, wrong, missed


def test_unseen_documents(field):
    right, wrong, missed = figures(field, 99)
    assert right >= 0.95 * (right + wrong) and right >= 0.65 * (right + missed)
    fewer, _, _ = figures(without_skips(field), 99)
    assert fewer < 0.5 * right


def exact(field, words, gaps, observed):
    """Marginals by summing over all labellings."""
    n, size = len(words), len(pii.LABELS)
    unary = field.scores(words, gaps)
    edges = [(i - 1, i, field.chain) for i in range(1, n) if gaps[i]] + [(i, j, np.diag(field.skip)) for i, j in pii._skips(words, gaps)]
    out = np.zeros((n, size))
    every = [range(size) if y < 0 else [y] for y in observed]
    scores = [(y, sum(unary[i, y[i]] for i in range(n) if observed[i] < 0) + sum(t[y[i], y[j]] for i, j, t in edges)) for y in itertools.product(*every)]
    most = max(s for _, s in scores)
    for y, s in scores:
        for i in range(n):
            out[i, y[i]] += np.exp(s - most)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(
    ("words", "gaps", "observed", "far"),
    [
        (["(988)", "555-2485", "2024", "10:30"], [False, True, True, True], [-1, -1, -1, -1], 1e-3),
        (["+44988555248", "555-2485", "12", "12"], [False, False, False, True], [4, -1, -1, -1], 1e-3),
        (["(988)", "555-2485", "(988)", "555-2485", "7"], [False, True, False, True, True], [-1, -1, -1, -1, -1], 0.15),
        (["a@b", "a@b.org", "a@b", "@b"], [False, False, False, True], [-1, 1, -1, -1], 0.15),
    ],
)
def test_message_passing_against_enumeration(field, words, gaps, observed, far):
    long = dataclasses.replace(field, passes=60)
    want = exact(field, words, gaps, observed)
    assert np.abs(pii.marginals(long, words, gaps, observed) - want).max() < far
    assert np.allclose(pii.marginals(long, words, gaps, observed), pii.marginals(long, words, gaps, observed, block=1))
    assert (pii.marginals(field, words, gaps, observed).argmax(axis=1) == want.argmax(axis=1)).all()


def test_neighbouring_cards_stay_apart(field):
    assert added("x 4524132264652876 4532015112830366 y", field) == ["4524132264652876", "4532015112830366"]
    assert pii._parts("1 4111 1111 1111 1111 9", 2, [(0, 1), (2, 6), (7, 11), (12, 16), (17, 21), (22, 23)]) == [(2, 2, 21)]


def test_failed_neighbours_are_found(field):
    text = "erntou +1 (269) 555-3296 4524132264652876 and"
    base, spans = pii.find(text, field)
    assert {text[s:e] for s, _, e in spans} == {"+1 (269) 555-3296", "4524132264652876"}


def test_digest_and_redaction(spark, odd, odd_rows, empty):
    rows = pii.digest(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.spans == "" for r in rows)
    assert pii.digest(empty).collect() == []
    df = spark.createDataFrame([(1, "mail bob@x.org or 10.0.0.1"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP]", None]
    assert pii.redact("abcdef", [(1, 0, 4), (2, 1, 5)]) == "a[EMAIL]f"
