import binascii
import hashlib
from collections import defaultdict

import pytest

from quern.llm import prefix_trie as T

KINDS = "conv_id bigint, turn bigint, role string, text string, extra string"


def brute(rows):
    """Nodes by comparing sequences of turns."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = binascii.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items())


def found(spark, tmp_path, rows):
    spark.createDataFrame([(*r, None)[:5] for r in rows], KINDS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(tuple(r) for r in T.op12_prefix_trie(spark, str(tmp_path)).collect())


def test_nodes_equal_brute_force(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", None)[t % 3], f"{'é' * (c % 3)} text {t * (c % 2)}" if (c + t) % 7 else None) for c in range(0, 320, 3) for t in range(c % 9)]
    rows += [(c, t, "user", "hello") for c in range(1000, 1300, 100) for t in range(4)] + [(c, t, "user", f"hello {t}") for c in range(1001, 1090) for t in range(6)]
    rows += [(-5, None, "user", "x"), (-5, 3, "user", "y"), (-7, -1, "", ""), (5000, 1, "a", "bc"), (5001, 1, "ab", "c"), (None, 1, "user", "of none")]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_repeated_rows_and_turns_of_one_number(spark, tmp_path):
    rows = [(c, 0, "user", "same") for c in (200, 201, 202) for _ in range(3)] + [(202, 1, "user", "more")]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_a_long_conversation_spans_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    rows = [(c, t, "user", f"t{t}" if t < 40 or c == 300 else f"c{c} {t}") for c in (300, 301, 302) for t in range(60)]
    rows += [(c, t, "user", f"t{t}" if t < 33 else "z") for c in (400, 400 + 100) for t in range(50)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_members_in_many_pieces_and_hot_parents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 20)
    monkeypatch.setattr(T, "HOT", 3)
    rows = [(c, 0, "user", "all the same") for c in range(0, 60_000, 100)] + [(c, 0, "user", f"own {c}") for c in range(100_000, 130_000, 100)]
    assert found(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_no_conversation_no_root(spark, tmp_path, rows):
    assert found(spark, tmp_path, rows) == []


def test_a_turnless_conversation_is_at_the_root(spark, tmp_path):
    # conversation 7 has fewer turns than it skips, and its family's first is absent
    conv = next(c for c in range(1, 99) if binascii.crc32(str(c).encode()) % 6 > 1)
    assert found(spark, tmp_path, [(conv, 0, "user", "x")]) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_conversations_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "u", "ab"), (1, 1, "a", "c"), (2, 0, "u", "ab"), (2, 1, "a", "d"), (3, 0, "u", "ab")], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in T.as_they_are(rows).collect()}
    assert got == {(1, 0): (None, 3, 1, 2, 4), (1, 1): (1, 3, 2, 2, 4), (1, 2): (1, 1, 0, 1, 0), (2, 2): (1, 1, 0, 1, 0)}
