"""Prefix trie: the radix tree against a dictionary, the nodes against brute force over many small shards, edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.llm import prefixtrie

TURNS = "conv_id long, turn long, role string, text string, key string, name string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", 1) for r in rows], TURNS)


def brute_force(rows):
    """{(depth, smallest conversation): the other columns}, by plain prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h, head = zlib.crc32(str(c).encode()) % 4, own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        built = tuple(head[:h] + ts[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ended[built].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = {}
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) > len(q) and r[: len(q)] == q for r in below)]
        ends = hashlib.sha256(",".join(map(str, sorted(ended.get(p, [])))).encode()).hexdigest()
        out[len(p), min(who)] = (min(members[p[:-1]]) if p else None, len(who), sum(len(q) == len(p) + 1 for q in below), len(leaves), sum((len(members[q]) - 1) * words(q) for q in below), ends)
    return out


def rows_of(df):
    got = df.collect()
    found = {(r["depth"], r["conv_id"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got}
    assert len(found) == len(got)
    return found


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=300), st.integers(0, 3))
def test_radix_tree(keys, spread):
    keys = sorted(keys | {bytes([b, 7]) for b in range(64 * spread)})
    root = prefixtrie.Art()
    for row, key in enumerate(keys):
        prefixtrie.insert(root, key, row)
    found, todo = {}, [(root, b"")]
    while todo:
        node, above = todo.pop()
        here = above + node.path
        if node.row >= 0:
            found[here] = node.row
        assert len(node.children()) <= node.room and (node is root or node.row >= 0 or len(node.children()) > 1)
        for byte in range(256):
            if kid := node.find(byte):
                todo.append((kid, here + bytes([byte])))
    assert found == {k: i for i, k in enumerate(keys)}


def test_layouts_grow():
    root, rooms = prefixtrie.Art(), []
    for n in range(256):
        root.add((n * 37) % 256, prefixtrie.Art(bytes([n])))
        rooms.append(root.room)
        assert [root.find((k * 37) % 256).path for k in range(n + 1)] == [bytes([k]) for k in range(n + 1)]
    assert [rooms.index(r) for r in (4, 16, 48, 256)] == [0, 4, 16, 48]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.lists(st.sampled_from([b"a" * 16, b"a" * 15 + b"b", b"c" * 16]), max_size=5).map(b"".join), min_size=1, max_size=40), st.lists(st.integers(1, 6), max_size=12))
def test_shards_add_up_to_one_tree(keys, cuts):
    keys = sorted(keys)
    words = [[key[16 * d + 15] % 7 for d in range(len(key) // 16)] for key in keys]
    whole = {(keys[r[0]][: 16 * r[1]]): r[2:7] for r in prefixtrie.shard_nodes(keys, words, [i % 3 + 1 for i in range(len(keys))], [100 + i for i in range(len(keys))], ["x"] * len(keys), -1, -1)}
    sums, at = {}, 0
    parts = []
    for size in [*cuts, len(keys)]:
        if at < len(keys):
            parts.append((at, min(len(keys), at + size)))
            at = parts[-1][1]
    for k, (a, b) in enumerate(parts):
        before = prefixtrie.shared(keys[a - 1], keys[a]) // 16 if a else -1
        after = prefixtrie.shared(keys[b - 1], keys[b]) // 16 if b < len(keys) else -1
        for r in prefixtrie.shard_nodes(keys[a:b], words[a:b], [i % 3 + 1 for i in range(a, b)], [100 + i for i in range(a, b)], ["x"] * (b - a), before, after):
            p = keys[a + r[0]][: 16 * r[1]]
            assert p not in sums or r[9] or r[10]
            old = sums.get(p, (10**9, 0, 0, 0, 0))
            sums[p] = (min(old[0], r[2]), *(x + y for x, y in zip(old[1:], r[3:7], strict=True)))
    assert sums == whole


def test_nodes_equal_brute_force(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if c % 5 else c} " * (t + 1)) for c in range(-7, 130) for t in range(c % 6)]
    rows += [(c, t, "user", f"common {t}") for c in range(200, 300) for t in range(3)]  # copies
    rows += [(c, 0, "user", f"common {0}") for c in range(300, 340)] + [(400, t, "user", f"long {t}") for t in range(300)]
    want = brute_force(rows)
    for shard_turns in (5, 100_000):
        assert rows_of(prefixtrie.prefix_trie(frame(spark, rows), shard_turns)) == want


def test_edge_cases(spark):
    rows = [(None, 1, "user", "no id"), (40, None, None, None), (40, 1, "user", None), (40, 1, "user", "b"), (40, 1, "user", "b"), (40, 1, "system", "z"), (41, 5, "user", "x" * 200_000), (47, 0, "", "only one"), (20, 0, "user", "a a a")]
    assert rows_of(prefixtrie.prefix_trie(frame(spark, rows))) == brute_force(rows)
    assert prefixtrie.prefix_trie(frame(spark, [])).count() == 0
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    turnless = [(lone, 0, "user", "gone")]  # its head has no turns and its own first turn is replaced
    assert rows_of(prefixtrie.prefix_trie(frame(spark, turnless))) == {(0, lone): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())} == brute_force(turnless)


def test_ends_in_pieces(monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    rows = [("a", i) for i in range(10)] + [("b", 1), ("c", 2), ("c", 5), ("d", 7)] + [("e", i) for i in range(7)]
    ranges = [rows[:4], rows[4:9], rows[9:16], rows[16:]]
    parts = pd.concat([x for part in ranges for x in prefixtrie._runs(iter([pd.DataFrame(part[:2], columns=["name", "conv_id"]), pd.DataFrame(part[2:], columns=["name", "conv_id"])]))])
    whole = parts[parts["piece"].isna()][["name", "first", "n", "ends"]]
    pieces = parts[parts["piece"].notna()].sort_values(["name", "first"])
    assert pieces["n"].max() <= 3
    found = pd.concat([whole, *prefixtrie._joined(iter([pieces[:2], pieces[2:]]))])
    want = {k: (min(v), len(v), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k in "abcde" if (v := [i for n, i in rows if n == k])}
    assert {r["name"]: (r["first"], r["n"], r["ends"]) for _, r in found.iterrows()} == want
