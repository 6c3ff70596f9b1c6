"""Operators through their own interfaces, beyond what the queries ask of them."""

import io
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import edit_prints, language, licenses, media, mixing, near_dedup, packing, suffix_dedup, token_frames, tokens, url_filters
from gleanery.llm.components import components


def test_media_boxes_of_other_shapes(spark):
    """Wide sizes, boxes to the end, unknown boxes, two chunks of other lengths, no sync table, files cut short."""
    payload = bytes(range(192)) * 40
    plain = media.wrap_frames(payload)
    wide = plain[: len(media._FTYP)] + struct.pack(">I", 16) + b"free" + bytes(8)
    shifted = struct.pack(">I", 1) + b"skip" + struct.pack(">Q", 24) + bytes(8)
    cut = plain[:300]
    assert media.read_payload(plain) == payload
    frames = media.tracks(plain)[0][0]
    assert len(frames.offsets) == 40 and [k[1] for k in frames.keyframes()] == [192, 192, 192]
    assert plain[frames.keyframes()[1][0] :][:192] == payload[16 * 192 :][:192]
    files = {0: plain, 1: None, 2: b"", 3: cut, 4: plain + shifted, 5: plain[:-10], 6: b"\0\0\0\4moov", 7: wide, 8: plain.replace(b"stss", b"xxxx")}
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), "x") for i, b in files.items()], "n int, file binary, codec string")
    got = {r.n: r for r in media.describe_media(df, "n", "file").collect()}
    assert (got[0].codec, got[0].handler, got[0].seconds, got[0].samples, len(got[0].keyframes), got[0].error) == ("raw", "vide", 1.6, 40, 3, None)
    assert got[1].error == "null" and got[2].error == "no movie" and got[7].error == "no movie"
    assert got[3].error and got[6].error and got[5].error == "box mdat leaves its parent"
    assert got[4].samples == 40 and got[4].error is None
    assert len(got[8].keyframes) == 40
    with pytest.raises(ValueError):
        media.wrap_frames(b"")


def media_track(number, handler, codec, scale, ticks, sizes, places, sync=None):
    full, box = media._full, media._box
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    tables = [full(b"stsd", ints(1), box(codec, bytes(8))), full(b"stts", ints(0)), full(b"stsz", ints(0, len(sizes)), ints(*sizes))]
    tables += [full(b"stsc", ints(1, 1, 1, 1) if sizes else ints(0)), full(b"stco", ints(len(places)), ints(*places))]
    tables += [full(b"stss", ints(len(sync), *sync))] if sync else []
    minf = box(b"minf", full(b"hdlr", b"dhlrurl ", bytes(12)), box(b"stbl", *tables))
    mdia = box(b"mdia", full(b"mdhd", ints(0, 0, scale, ticks, 0)), full(b"hdlr", bytes(4), handler, bytes(12)), minf)
    return box(b"trak", full(b"tkhd", ints(0, 0, number, 0, ticks), bytes(60)), mdia)


def test_every_track_is_described(spark):
    """The sound comes first; the video's keyframes are the file's, and a spoiled track leaves the other one."""
    sound = lambda places: media_track(1, b"soun", b"mp4a", 48_000, 96_000, [10, 10, 10], places)
    video = media_track(2, b"vide", b"avc1", 1000, 4000, [50, 20, 60], [230, 280, 300], [1, 3])
    data = media._box(b"mdat", bytes(400))
    files = [data + media._box(b"moov", sound(places), video) for places in ([200, 210, 220], [200, 210, 90_000])]
    files.append(data + media._box(b"moov", sound([200, 210, 220])))
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "n int, file binary")
    whole, spoiled, heard = media.describe_media(df, "n", "file").orderBy("n").collect()
    for got in (whole, spoiled):
        assert (got.codec, got.handler, got.seconds, got.samples) == ("avc1", "vide", 4.0, 3)
        assert [tuple(k) for k in got.keyframes] == [(230, 50), (300, 60)] and len(got.tracks) == 2
    assert whole.error is None and [(t.codec, t.seconds, len(t.keyframes), t.error) for t in whole.tracks] == [("mp4a", 2.0, 3, None), ("avc1", 4.0, 2, None)]
    assert spoiled.error == "sample outside the file" and [t.error for t in spoiled.tracks] == [spoiled.error, None]
    assert (heard.codec, len(heard.keyframes), heard.error) == ("mp4a", 3, None)


def test_fragments_are_described():
    """Defaults of the movie, of a fragment and of single samples; runs with and without a place of their own."""
    full, box = media._full, media._box
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    extends = box(b"mvex", full(b"trex", ints(1, 1, 40, 7, media.NOT_SYNC)), full(b"trex", ints(2, 1, 1024, 5, 0)))
    head = box(b"moov", media_track(1, b"vide", b"avc1", 1000, 0, [], []), media_track(2, b"soun", b"mp4a", 1024, 0, [], []), extends)

    def moof(shift):
        one = box(b"traf", full(b"tfhd", ints(1), flags=0x20000), full(b"trun", ints(3, shift, 0), ints(30, 20, 10), flags=0x205), full(b"trun", ints(2)))
        two = box(b"traf", full(b"tfhd", ints(2), ints(512), flags=0x8), full(b"trun", ints(4)))
        return box(b"moof", full(b"mfhd", ints(1)), one, two)

    size = len(moof(0))
    part = moof(size + 8) + box(b"mdat", bytes(94))
    found, _, error = media.tracks(head + part + part)
    first = len(head) + size + 8
    video, sound = found
    assert error is None
    assert video.offsets.tolist() == [p + x for p in (first, first + len(part)) for x in (0, 30, 50, 60, 67)] and video.sizes.tolist() == [30, 20, 10, 7, 7] * 2
    assert video.keyframes().tolist() == [[first, 30], [first + len(part), 30]] and video.ticks == 400
    assert sound.offsets[:4].tolist() == [first + x for x in (74, 79, 84, 89)] and len(sound.keyframes()) == 8 and sound.ticks == 4096
    about = media._described(head + part + part)
    assert (about["codec"], about["seconds"], about["samples"]) == ("avc1", 0.4, 10)
    assert media._described(head + part + part[:-94] + bytes(20))["error"]
    assert media._described(part)["error"] == "fragment of an unknown track"


def test_sample_tables():
    track = media.Track()
    track._sizes = np.array([5, 6, 7, 8, 9])
    track._chunks, track._runs = np.array([100, 200, 300]), np.array([[1, 2, 1], [3, 1, 1]])
    track.settle()
    assert track.offsets.tolist() == [100, 105, 200, 207, 300]
    track._runs = np.array([[1, 2, 1]])
    with pytest.raises(ValueError):
        track.settle()


class Held(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames_are_read_one_by_one():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (1, 5, 70_000, 3, 100_000, 2, 9, 1)]
    file = Held()
    writer = token_frames.FrameWriter(file)
    for d in docs:
        writer.add(d)
    writer.finish()
    reader = token_frames.FrameReader(file)
    assert [b for _, b in reader.documents()] == docs
    opened = []
    inner = reader.frame
    reader.frame = lambda n: opened.append(n) or inner(n)
    assert [b for _, b in reader.documents([3, 5, 6])] == [docs[3], docs[5], docs[6]]
    assert len(opened) == 2  # the two large documents have frames of their own, which stay closed
    spoiled = bytearray(file.getvalue())
    spoiled[20] ^= 1
    with pytest.raises(Exception):
        list(token_frames.FrameReader(Held(bytes(spoiled))).documents([0]))
    with pytest.raises(ValueError):
        token_frames.FrameReader(Held(b"no table at all, but long enough"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    rng = random.Random(2)
    tool = tokens.Encoder(tokens.vocabulary(name))
    alphabets = ["abcXYZ éÈüñŻİſ'’ 's'T\t\n\r\x0b\x1c  0123²½٣_-!!..,<|endoftext|>漢字日本😀́ﬁ", "abABZ éÈüñŻ'sStTreRE vVeEmMLldD\t\n\r  0123_-!!..,«»¿"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(3000)]
    assert tool.encode(texts) == tool._library(texts)


def test_best_fit_bins():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 5000)
    bins = packing.best_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(5000)) and all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) <= 1.01 * np.ceil(lengths.sum() / 100) + 1


def test_rounds_go_on_while_they_merge(spark, monkeypatch):
    """Partitions of forty items end within 8 in 100 of one packing of all, no item lost."""
    monkeypatch.setattr(packing, "ITEMS", 40)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2049, 1200).tolist()
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, length long")
    found = packing.pack(rows).toPandas()
    assert sorted(found["id"]) == list(range(len(sizes)))
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum().tolist()[:-1]] and bin_["length"].sum() <= 2048
    whole = len(packing.best_fit(np.array(sizes), 2048))
    assert found["sequence_id"].nunique() <= 1.08 * whole


def test_items_that_cannot_be_packed_raise(spark):
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(0,), (5,)], "length int"), capacity=10).collect()


def test_rules_of_any_kind(spark):
    rules = spark.createDataFrame([("a.b", "", "block"), ("A.B", "/x", "allow"), ("b", "/x/y", "block"), ("", "/", "block"), (None, "/", "block"), ("a.b", "/x", "block"), ("com", None, "allow")], "host string, path string, verdict string")
    urls = {"http://a.b": ("a.b", "block"), "http://c.a.b/xyz": ("a.b/x", "block"), "http://b/x/y": ("b/x/y", "block"), "http://q.com/": (None, "allow"), "http:///x": (None, "allow"), "http://ba.b/x/yz": ("b/x/y", "block")}
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, host int")
    got = {r.url: (r.rule, r.verdict) for r in url_filters.judge_urls(df, rules, keep=("url",)).collect()}
    assert got == urls
    none = url_filters.judge_urls(df, rules.limit(0), keep=("url",), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_suffix_sort_equals_sorted():
    rng = random.Random(4)
    data = "".join(rng.choice("ab") for _ in range(900)).encode()
    starts = np.array([rng.randrange(0, 880) for _ in range(300)])
    stops = np.minimum(starts + np.array([rng.randrange(0, 60) for _ in range(300)]), 900)
    group = np.sort(np.array([rng.randrange(0, 20) for _ in range(300)]))
    order, shared = suffix_dedup.suffix_sort(np.frombuffer(data, np.uint8), group, starts, stops)
    text = [data[a:b] for a, b in zip(starts, stops)]
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        mine = [i for i in order.tolist() if group[i] == g]
        assert [text[i] for i in mine] == sorted(text[i] for i in at)
        for place, (a, b) in zip(at[1:], zip(mine, mine[1:])):
            common = next((k for k, (x, y) in enumerate(zip(text[a], text[b])) if x != y), min(len(text[a]), len(text[b])))
            assert shared[place] == common


def test_a_hash_collision_is_put_right():
    data = np.frombuffer(b"abcdefghabcdxfgh", np.uint8)
    assert suffix_dedup._verified(data, np.array([0]), np.array([8]), np.array([8])).tolist() == [4]


def test_long_texts_are_taken_in_pieces(monkeypatch, spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000)) + passage + "".join(rng.choice("abcdefgh ") for _ in range(4000)) + passage
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    whole = suffix_dedup.remove_repeats(df).collect()[0]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert suffix_dedup.remove_repeats(df).collect()[0] == whole
    assert whole.n_removed >= 3000 and whole.n_spans == 2


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (700, 500), (900, 900)]
    got = {r.v: r.u for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500, 700: 500}


def test_near_copies_are_one_and_strangers_are_not(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for k in range(300):
        words = list(base)
        words[rng.randrange(400)] = f"new{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert {got[i] for i in range(301)} == {0} and all(got[i] == i for i in range(301, 401))
    kept = near_dedup.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(301, 401)] and kept.columns == ["doc_id", "text"]


def test_signatures_estimate_the_similarity():
    a = near_dedup.shingle_set(" ".join(f"w{i}" for i in range(1000)).encode(), 1)
    b = near_dedup.shingle_set(" ".join(f"w{i}" for i in range(200, 1000)).encode(), 1)
    both = near_dedup._signatures([a, b, np.zeros(0, np.uint64)])
    assert len(a) == 1000 and abs((both[0] == both[1]).mean() - 0.8) < 0.2 and not both[2].any()


def test_signatures_lose_a_link_in_ten_millions_at_most():
    """The exact binomial tail: a pair at the threshold agrees in too few of its hashes."""
    n, least = near_dedup.HASHES, int(np.ceil(near_dedup._least(80)))
    missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
    assert least == 32 and missed < 1e-7


def test_links_with_unlucky_signatures_are_found(spark):
    """Pairs of similarity 0.8 found by a search, whose signatures agree in 35 or 36 of 64 places."""
    texts = {}
    for n, k in enumerate((5496, 68180, 143247, 247198)):
        pair = [" ".join(f"{k}x{i}" for i in range(first, first + 9)) for first in (0, 1)]
        both = near_dedup._signatures([near_dedup.shingle_set(t.encode(), 1) for t in pair])
        assert (both[0] == both[1]).sum() in (35, 36)
        texts |= {10 * n: pair[0], 10 * n + 1: pair[1]}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, words=1).collect()}
    assert got == {i: i // 10 * 10 for i in texts}


def test_fingerprints_are_searched_by_bands(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(60)]
    texts += [t[: len(t) // 2] + " !" + t[len(t) // 2 :] for t in texts[:30]]
    prints = edit_prints.fingerprint_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    found = edit_prints.search_prints(prints, prints.where("doc_id < 30"), least=0.8).collect()
    of = {r.doc_id: r.fingerprint for r in prints.collect()}
    pairs = {(r["query"], r.fingerprint) for r in found}
    assert {(of[i], of[i]) for i in range(30)} <= pairs
    assert sum((of[i], of[60 + i]) in pairs for i in range(30)) >= 27
    assert pairs <= {(of[i], of[j]) for i in range(30) for j in (i, 60 + i)}


def test_search_finds_pairs_at_its_threshold(spark):
    """Recall against brute force for fingerprints of likeness 0.8 to 0.85; an empty text is like none of them."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2, (500, 256)).astype(np.uint8)
    near = base.copy()
    for row in near:
        row[rng.choice(256, rng.integers(45, 53), replace=False)] ^= 1
    one, two = np.packbits(base, 1), np.packbits(near, 1)
    names = lambda prints: [(x.tobytes().hex(),) for x in prints]
    true = {(a[0], b[0]) for x, a in zip(one, names(one)) for b, y in zip(names(two), edit_prints.likeness(np.repeat(x[None], 500, 0), two)) if y >= 0.8}
    assert len(true) == 500
    found = edit_prints.search_prints(spark.createDataFrame([*names(two), ("0" * 64,)], "fingerprint string"), spark.createDataFrame(names(one), "fingerprint string"), least=0.8).collect()
    pairs = {(r["query"], r.fingerprint) for r in found}
    assert pairs <= true and len(pairs) >= 0.9 * len(true)
    every = edit_prints.search_prints(spark.createDataFrame(names(two[:9]), "fingerprint string"), spark.createDataFrame(names(one[:9]), "fingerprint string"), least=0.0)
    assert every.count() == 81


def test_found_texts_are_confirmed_by_edits(spark):
    rng = random.Random(11)
    texts = [" ".join(f"wört{rng.randrange(900)}" for _ in range(150)) for _ in range(20)]
    edited = [t[:300] + "ÿ!" + t[301:] for t in texts]
    docs = spark.createDataFrame([*enumerate(edited), (50, edited[3]), (60, None), (61, "")], "doc_id int, text string")
    asked = spark.createDataFrame([*enumerate(texts), (70, "")], "doc_id int, text string")
    got = {(r.query_id, r.id): r.edits for r in edit_prints.search_texts(docs, asked).collect()}
    assert got.pop((70, 60)) == 0
    assert set(got) <= {(i, i) for i in range(20)} and len(got) >= 19 and set(got.values()) == {2}
    assert {r.edits for r in edit_prints.search_texts(docs, asked, most_edits=0.001).collect()} == {0}


def test_an_edit_changes_few_bits():
    rng = random.Random(8)
    text = " ".join(f"word{rng.randrange(900)}" for _ in range(800))
    edited = text[:2000] + "inserted " + text[2000:]
    other = " ".join(f"word{rng.randrange(900)}" for _ in range(800))
    a, b, c, empty = edit_prints.fingerprints([text, edited, other, ""])
    assert edit_prints.likeness(a[None], b[None])[0] > 0.9 > 0.5 > edit_prints.likeness(a[None], c[None])[0]
    assert edit_prints.likeness(empty[None], empty[None])[0] == 1 and edit_prints.likeness(empty[None], a[None])[0] == 0


def test_odds_tilt_the_mix(spark):
    """Of two halves of a source the one with higher odds is taken far more often, and words come near the target."""
    rows = [(i, "w " * (1 + i % 20), "a", 9.0 if i % 2 else 1.0) for i in range(4000)] + [(9000 + i, "w " * 400, "b", None) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, odds double")
    weights = lambda totals: totals.select("source", F.when(F.col("source") == "a", 1.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(df, weights=weights, odds="odds", keep=("doc_id", "source")).collect()
    a = [r for r in got if r.source == "a"]
    assert abs(sum(r["size"] * r.copies for r in a) - a[0].target) <= 20
    odd, even = (np.mean([r.copies for r in a if r.doc_id % 2 == k]) for k in (1, 0))
    assert odd > 1.3 * even


def test_no_document_left_out_fits_its_gap(spark):
    """Sources of few documents with widely spread sizes, which need more than four cuts."""
    rng = random.Random(12)
    rows = [(1000 * s + i, "w " * int(3 ** rng.uniform(0, 7)), f"s{s:03}") for s in range(150) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mixing.mix(df, keep=("doc_id", "source")).collect()
    gap = {r.source: r.target for r in got}
    for r in got:
        gap[r.source] -= r["size"] * r.copies
    assert len(gap) == 150 and min(gap.values()) > -1e-6
    assert not [r for r in got if r.copies == r.target // r.source_size and 0 < r["size"] <= gap[r.source]]


def test_small_cells_choose_the_same(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    whole = sorted(mixing.mix(df, keep=("doc_id",)).collect())
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    assert sorted(mixing.mix(df, keep=("doc_id",)).collect()) == whole


def test_many_languages_share_the_budget(spark):
    """No language is left out however few rows each may give."""
    words = {f"l{k:02d}": " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x{j}" for j in range(12)) for k in range(30)}
    rows = [(100 * k + i, text, lang) for k, (lang, text) in enumerate(words.items()) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(docs, budget=60)
    assert net.labels == sorted(words)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id int, text string, lang string")
    assert language.train(docs) is None
    assert {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, None, keep=("doc_id",)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_partial_notices_need_their_key_phrase(spark):
    texts = {
        0: "Redistribution and use in source and binary forms, with or without",
        1: "redistribution and use in SOME source and binary forms",
        2: "use of source and binary forms",
        3: "source and binary",
        4: "Released under the MIT-License. GNU Lesser General Public License",
        5: "KKernel of cc  éby cc",
        6: None,
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()}
    assert got[0].labels == "bsd" and got[0].score == 1.0 and got[0].n_base == 0
    assert got[3].labels == "" and got[4].base_labels == "mit" and got[4].labels == "lgpl,mit,mit-notice"
    assert got[5].labels == "" and got[5].n_words == 5 and (got[6].n_words, got[6].score) == (0, 0.0)


def test_few_others_in_a_large_node_meet_its_crowd_at_once(spark):
    """Every row of another label meets every row of the node in some group; rows of the crowd's label alone meet nowhere."""
    from gleanery.llm import near_dedup as nd

    rows = spark.range(1200).selectExpr("7L AS node", "1200L AS n", "0L AS crowd", "5L AS others", "id AS c", "if(id < 5, id + 1, 0) AS label")
    groups = {}
    for r in nd._blocks(rows).collect():
        groups.setdefault(r.g, set()).add((r.c, r.label))
    met = {(a, b) for g in groups.values() for a, label in g if label for b, _ in g}
    assert met == {(a, b) for a in range(5) for b in range(1200)}
    assert all(any(label for _, label in g) for g in groups.values()) and len(groups) == 6
