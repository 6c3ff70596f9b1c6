"""Token alignment against byte offsets compared token by token."""

import hashlib
from collections import Counter, defaultdict

import pytest

from gleanery.llm import alignment
from gleanery.llm.queries import QUERIES
from gleanery.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def sides():
    """Ids and bytes of a text's tokens, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    spelled = {i: bytes(letters[c] for c in t) for t, i in library.get_vocab().items() if all(c in letters for c in t)}

    def both(text):
        if not text:
            return [], []
        a = [(i, spelled[i]) for i in library.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    return both


def ends(tokens):
    out, n = [], 0
    for _, raw in tokens:
        n += len(raw)
        out.append(n)
    return out


def expected(sides, rows):
    made, counts = [], Counter()
    for i, text in rows:
        a, b = sides(text)
        place = {e: k for k, e in enumerate(ends(b))}
        links = [(k, place[e]) for k, e in enumerate(ends(a)) if e in place]
        counts.update((a[x][0], b[y][0]) for x, y in links)
        made.append((i, a, b, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for i, a, b, links in made:
        cuts = [(-1, -1), *links]
        groups = ";".join(f"{','.join(str(t) for t, _ in a[p + 1 : x + 1])}|{','.join(str(t) for t, _ in b[q + 1 : y + 1])}" for (p, q), (x, y) in zip(cuts, links))
        sums = [counts[(a[x][0], b[y][0])] for x, y in links]
        yield (i, len(a), len(b), len(links), len(links), sum(n == best[b[y][0]] for n, (_, y) in zip(sums, links)), sum(sums), hashlib.sha256(groups.encode()).hexdigest() if a else "")


ODD = ["<|endoftext|> and <s> </s> <unk>", "ﬁ ½ ①", "▁ under", "  two  blanks ", "\ttab\r\n\n", "日本語 テキスト", "नमस्ते दुनिया", "😀👩‍👩‍👧", "\x00\x01", "é", "　wide", "x" * 3000, " " * 2500, "\n" * 1200 + "a", " ", "<0x41>A"]


@pytest.mark.parametrize("window", [1 << 18, 3])
def test_query_equals_brute_force(spark, nasty, sides, monkeypatch, window):
    monkeypatch.setattr(alignment, "WINDOW", window)
    rows = [(r[0], r[1] if window > 3 else (r[1] or "")[:500]) for r in nasty[0]] + [(9000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_a string, links int")
    got = alignment.link_digests(docs)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(sides, rows), key=str)


def test_registered_query(spark, nasty, sides):
    got = [tuple(r) for r in QUERIES["op13_token_alignment"](spark, nasty[1]).collect()]
    assert sorted(got, key=str) == sorted(expected(sides, [(r[0], r[1]) for r in nasty[0]]), key=str)


def test_overlaps_and_groups(spark, sides):
    texts = ["hello  wörld, tokens", None, *ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "links int, text string")
    for r in alignment.align(df, keep=("links",)).collect():
        a, b = sides(texts[r.links])
        assert r.a_ids == [i for i, _ in a] and r.b_ids == [i for i, _ in b]
        ea, eb = ends(a), ends(b)
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(ea[x] - len(a[x][1]), eb[y] - len(b[y][1])) < min(ea[x], eb[y])]
        assert [tuple(p) for p in r.overlaps] == want
        cuts = [(x, y) for x, y in want if ea[x] == eb[y]]
        assert [tuple(g) for g in r.groups] == [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip([(-1, -1), *cuts], cuts)]


def test_pairs_that_can_be_linked():
    vocabs = alignment.vocabularies(*alignment.paths_of_vocabularies())
    pairs, n = vocabs.pairs(), len(vocabs.b_bytes)
    assert 0 < len(pairs) <= int(vocabs.a_sizes.sum() + vocabs.b_sizes.sum())
    for code in pairs[::997].tolist():
        a, b = vocabs.a_bytes[code // n], vocabs.b_bytes[code % n]
        assert a.endswith(b) or b.endswith(a)
