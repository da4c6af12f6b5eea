from __future__ import annotations

import hashlib
import random

import pytest

from paceline.llm import prefix_hashes as ph
from paceline.llm.common import table
from tests.conftest import SF_DIR


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def likeness(a, b):
    """The same search on the strings themselves."""
    if not a and not b:
        return 1.0
    head = common(a, b)
    tail = min(min(len(a), len(b)) - head, common(a[::-1], b[::-1]))
    end, its_end = len(a) - tail, len(b) - tail
    mine, its, covered = head, head, 0
    for start in range(-(-head // ph.BLOCK) * ph.BLOCK, end - ph.BLOCK + 1, ph.BLOCK):
        if start < mine:
            continue
        there = b.find(a[start : start + ph.BLOCK], its, its_end)
        if there < 0:
            continue
        back = common(a[mine:start][::-1], b[its:there][::-1])
        on = common(a[start:end], b[there:its_end])
        covered += back + on
        mine, its = start + on, there + on
    return (head + tail + covered) / max(len(a), len(b))


def test_likeness_goes_on_after_each_change():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_000))
    like = lambda a, b: ph.Prefixes.of(a).likeness(ph.Prefixes.of(b))
    assert like(text, "x" * 10 + text[10:-1] + "y") > 0.95
    shifted = "new " * 5 + text[:300] + "and " * 9 + text[300:700] + text[760:] + "!"
    assert like(text, shifted) > 0.85 and like(shifted, text) > 0.85
    other = "".join(rng.choice("ijklmnop ") for _ in range(1_000))
    assert like(text, other) < 0.05 and like(text, text) == 1.0
    for _ in range(150):
        alphabet = rng.choice(["ab", "abcdefgé𝄞", "a"])
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        b = a
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b = b[:at] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + b[at + rng.randint(0, 60) :]
        assert like(a, b) == pytest.approx(likeness(a, b))


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("abé𝄞") for _ in range(rng.randint(0, 30))) for _ in range(2))
        x, y = ph.Prefixes.of(a), ph.Prefixes.of(b)
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            assert x.extension(i, y, j) == common(a[i:], b[j:])
            assert x.extension(i, y, j, back=True) == common(a[:i][::-1], b[:j][::-1])
        keep, take = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert x.joined(keep, y, take).text() == ph.Prefixes.of(a[:keep] + b[:take]).text()
        assert (x.text() == y.text()) == (a == b)


def check(docs, rows):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = []
    for k, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = (ph.Prefixes.of(text).text(), ph.Prefixes.of(edited).text())
        digest = hashlib.sha256(edited.encode()).hexdigest()
        wanted.append((doc_id, len(text), digest, *prints, likeness(text, edited), likeness(text, after)))
    key = lambda r: tuple(map(str, r))
    for a, b in zip(sorted(wanted, key=key), sorted(map(tuple, rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_query_against_plain_strings(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    check([tuple(d) for d in docs], ph.op9_prefix_fingerprints(spark, SF_DIR).collect())


def test_nulls_repeats_and_long_texts(odd):
    check([tuple(d) for d in odd.select("doc_id", "text").collect()], ph.fingerprint_edits(odd).collect())


def test_one_row_and_none(spark, none):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    check([(5, "abcd")], ph.fingerprint_edits(one).collect())
    assert ph.fingerprint_edits(none).count() == 0
