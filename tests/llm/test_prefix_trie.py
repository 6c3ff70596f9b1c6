"""The prefix trie against nodes found by comparing whole sequences, in trees and blocks of every size."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from gleanery.llm import prefix_trie
from gleanery.llm.queries import ORACLES, QUERIES

from .conftest import conversation_rows



def sequences(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0), role, text[:64], hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[1], x[4]) for x in sorted(v)] for c, v in turns.items()}
    return {c: tuple(own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :]) for c, v in own.items()}


def expected(rows):
    whole = sequences(rows)
    members, children, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    out = []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
        ends = ",".join(str(c) for c in sorted(members[path]) if whole[c] == path)
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("block, items, ids", [(64, 20_000, 20_000), (1, 1, 1), (2, 3, 2), (7, 5, 3)])
def test_nodes_equal_brute_force(spark, nasty, monkeypatch, block, items, ids):
    """Also with blocks of one turn and trees of one item, where every node is a boundary node."""
    for name, value in (("BLOCK", block), ("ITEMS", items), ("IDS", ids)):
        monkeypatch.setattr(prefix_trie, name, value)
    got = QUERIES["op12_prefix_trie"](spark, nasty[1])
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == expected(conversation_rows())


def test_sql_equals_brute_force(nasty):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{nasty[1]}/conversations.parquet' WHERE coalesce(conv_id, 0) NOT BETWEEN 640 AND 642")
    rows = [r for r in conversation_rows() if r[0] not in (640, 641, 642)]
    assert sorted(con.execute(ORACLES["op12_prefix_trie"]).fetchall(), key=str) == expected(rows)


def test_search_tree():
    words = sorted([[1], [1, 2], [1, 2, 3], [2, 9], [2, 4], [7], []])
    tree = prefix_trie.SearchTree()
    paths = {}
    for i in prefix_trie.medians(len(words)):
        paths[tuple(words[i])] = tree.insert(words[i])
    assert sorted(prefix_trie.medians(7)) == list(range(7)) and next(prefix_trie.medians(7)) == 3
    assert paths[(1, 2)] == paths[(1, 2, 3)][:3] and paths[(1,)] == paths[(1, 2)][:2] and paths[()] == [0]
    assert [tree.symbol[n] for n in paths[(2, 9)]] == [-1, 2, 9] and tree.depth[paths[(2, 4)][-1]] == 2


def test_a_conversation_without_turns_of_its_own(spark, tmp_path):
    """Own turns all fall to a head that is absent: a member of the root alone."""
    lone = next(c for c in range(7001, 7100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    turns = spark.createDataFrame([(lone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    placed = prefix_trie.ordered_turns(turns)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(placed), placed.select("conv_id").distinct()).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
