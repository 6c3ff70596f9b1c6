"""Small corpora with everything that tends to go wrong: nulls, ties, repeated rows, long texts, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Names that operators use inside; a table may have them too.
CLASHING = ["id", "row", "n", "c", "label", "size", "copies", "g", "h", "found", "sequence_id", "offset", "length", "host", "rule", "lang_pred", "score", "fill", "members", "__lang", "__null", "no_text", "columns", "keep", "packed"]
WORDS = {
    "en": "the and of that was from with here there which stone water house green light small where other thing under",
    "de": "der die und nicht ein mit von auf haus wasser stein licht klein grün über straße größe wenn aber doch",
    "fr": "le la les est dans pour avec maison eau pierre lumière petit vert où être très même mais donc sous",
}


def words(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "", "a", "in", "er", "ou", "st"]) for _ in range(n))


def nasty_rows():
    rng = random.Random(3)
    rows = []
    add = lambda i, text, lang="en", source="s0": rows.append((i, text, lang, source))
    for i in range(120):
        lang = rng.choice(list(WORDS))
        add(i, words(rng, lang, rng.randint(5, 300)), lang, f"s{min(rng.randrange(6), rng.randrange(6))}")
    base = rows[7][1] + " " + words(rng, "en", 200)
    for i in range(200, 230):  # near copies
        parts = base.split()
        parts[rng.randrange(len(parts))] = f"edit{i}"
        add(i, " ".join(parts), "en", "s0")
    for i in range(240, 260):  # exact copies
        add(i, rows[11][1] + " Ends.", "fr", "s1")
    passage = words(rng, "de", 120)
    for i in range(260, 275):  # a shared passage between own words
        add(i, f"{words(rng, 'de', 40)} {passage} {words(rng, 'de', 30)}", "de", "s2")
    add(300, None, None, None)
    add(301, "", "en", "s0")
    add(302, "   \n\t ", "en", None)
    add(303, "12 34 !!", "en", "s3")
    add(304, "one", "en", "s3")
    add(305, "x", None, "s9")
    add(306, "a" * 5000, "en", "s0")
    add(307, "ab" * 3000 + "日本語 Ünïcode İ ſ K 😀 é" * 3, "fr", "Ω")
    add(308, words(rng, "en", 30_000), "en", "s0")
    add(309, "MIT License Apache license, CC-BY; gnu GENERAL public license. cc by cc by the mit license", "en", "s4")
    add(None, "no id at all but words", "en", "s0")
    add(None, None, None, None)
    rows += [rows[5], rows[5], (312, rows[5][1], "en", "s5")]  # repeated rows and a tie
    return rows


def conversation_rows():
    """(conv_id, turn, role, text): null and equal turns, repeated rows, no head to take, heads longer than the rest, copies, one long one."""
    rng = random.Random(5)
    rows = []
    for c in [*range(100, 130), *range(300, 420), 777, 901, 1001, 5]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "c d", "été", ""])))
    rows += [(100, None, "user", "first"), (100, 0, None, None), (300, 3, "user", None), (301, None, None, "x"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    for c in range(430, 470):  # copies
        rows += [(c, t, "user", f"copied {t}") for t in range(9)]
    rows += [(640, t % 40, "user", "long") for t in range(150)] + [(641, t % 40, "user", "long") for t in range(150)] + [(642, t % 40, "user", "long") for t in range(140)]
    return rows + [rows[3], rows[3], rows[50]]


def write_others(folder, labels, conversations):
    ints, texts = pa.int64(), pa.string()
    made = pa.table({"doc_id": pa.array([x[0] for x in labels], ints), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32()), "text": pa.array(["other"] * len(labels), texts)})
    pq.write_table(made, f"{folder}/labels.parquet")
    columns = dict(zip(("conv_id", "turn", "role", "text"), zip(*conversations))) if conversations else {n: [] for n in ("conv_id", "turn", "role", "text")}
    made = {n: pa.array(v, ints if n in ("conv_id", "turn") else texts) for n, v in columns.items()}
    pq.write_table(pa.table(made | {n: pa.array(["?"] * len(conversations), texts) for n in ("n", "pos", "block", "a", "least", "depth", "family", "row", "id")}), f"{folder}/conversations.parquet")
    return folder


def write_documents(folder, rows, clashing=True):
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}
    columns["n_chars"] = pa.array([len(r[1] or "") for r in rows], pa.int64())
    for name in CLASHING if clashing else ():
        columns[name] = pa.array([f"{name}{i % 7}" for i in range(len(rows))], pa.string())
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def nasty(tmp_path_factory):
    """(rows, sf_dir) of the nasty corpus."""
    rows = nasty_rows()
    labels = [(r[0], int(i % 3 == 0)) for i, r in enumerate(rows[:150])] + [(None, 1), (99_999, 1), (5, None), (5, 0), (0, 0)]
    return rows, write_others(write_documents(tmp_path_factory.mktemp("nasty") / "sf", rows), labels, conversation_rows())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    """sf_dir of a corpus without rows."""
    return write_others(write_documents(tmp_path_factory.mktemp("empty") / "sf", []), [], [])


def key(value):
    return tuple((x is not None, x) for x in value)
