"""Toxicity: folding, matching against a plain reading, exceptions, and what is learned from labels."""

import random
import re
import zlib

import pytest

from gleanery.llm import toxicity as tox
from gleanery.llm.queries import QUERIES


def test_folding_keeps_places():
    pairs = [("1d10t", "idiot"), ("ІDІОТ", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("in 2013 there", "in 2013 there"), ("$tupid", "stupid"), ("a 1 b", "a 1 b"), ("İx", "İx"), ("id10", "id10"), ("m0r0n!", "moron!"), ("", "")]
    for raw, want in pairs:
        assert tox.fold(raw) == want and len(tox.fold(raw)) == len(raw)


def plainly(lexicon, folded):
    """Every word looked at by itself."""
    masked = [(m.start(), m.start() + len(p)) for p in lexicon.exceptions for m in re.finditer(rf"(?<![^\W\d_])(?={re.escape(tox.fold(p))}(?![^\W\d_]))", folded)]
    total = 0.0
    for word in re.finditer(r"[^\W\d_]+", folded):
        best = None
        for term, weight in lexicon.terms.items():
            text = tox.fold(term.removesuffix("*"))
            if (word[0].startswith(text) if term.endswith("*") else word[0] == text) and (best is None or (weight, len(text)) > best):
                best = (weight, len(text))
        if best and not any(a <= word.start() and word.start() + best[1] <= b for a, b in masked):
            total += best[0]
    return total


def test_matches_equal_a_plain_reading(spark):
    rng = random.Random(1)
    lexicon = tox.Lexicon({"idiot": 2.0, "idi*": 1.5, "scum*": 1.0, "ab*": 0.5, "abc": 3.0, "ünd*": 4.0}, ["no idiot", "scumble", "abc abc"])
    parts = ["idiot", "1d1ot", "idiots", "no", "scum", "scumble", "scumbled", "abc", "ab", "a", "Ünder", "und", "ІDІОТ", "x", "7"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", ", ", "-", "  ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "abc abc abc", "idiot" * 3000, "idiot " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "score int, text string, matches string")
    got = {r.score: r for r in tox.totals(df, lexicon, keep=("score",), hits=True).collect()}
    for i, text in enumerate(texts):
        folded = tox.fold(text or "")
        assert got[i].total == pytest.approx(plainly(lexicon, folded))
        assert got[i].n_chars == len(text or "")
        assert all(folded[m.start : m.end] == tox.fold(m.term.removesuffix("*")) for m in got[i].matches)
    judged = {r.text: r for r in tox.toxicity(df, lexicon, keep=("text",)).collect()}
    assert judged[None].score == judged[""].score == pytest.approx(0.5) and judged["abc abc abc"].score == pytest.approx(0.5)


def corpus(n=1500, seed=2):
    """Toxic texts hold insults or stems with any ending; the harmless word beside them begins alike."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(5, 120))], i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["dolt", "brute", "zork" + word(), "d0lt"]))
        elif rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice(["dolten", "no dolt here"]))
        rows.append((i, " ".join(words), int(bad)))
    rows += [(n + k, rows[0][1] + f" {word()}", 1) for k in range(60)]  # near copies teach once
    return rows


def test_learned_terms_and_held_out_fold(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (10**9, 1)], "doc_id long, toxic int")
    lexicon = tox.learn(docs, labels, lambda i: ~tox.in_held_out(i))
    assert any("zork".startswith(t.removesuffix("*")) or t.startswith("zork") for t in lexicon.terms) and len(lexicon.terms) < 12
    judged = {r.doc_id: r.score for r in tox.toxicity(docs, lexicon, keep=("doc_id",)).collect()}
    held = [(judged[i] >= 0.5, y) for i, _, y in rows[:1500] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p for p, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.02 * len(held)
    assert tox.learn(docs, labels.where("false")) is None
    one_side = tox.learn(docs, labels.where("toxic = 0"))
    assert not one_side.terms and tox.toxicity(docs, one_side).first().score < 1e-9


def test_query(spark, nasty):
    rows, sf_dir = nasty
    got = QUERIES["op11_toxicity"](spark, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.doc_id: r.score for r in got}[300] == {r.doc_id: r.score for r in got}[301]
