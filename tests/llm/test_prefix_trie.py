"""op13's operator against plain dictionaries."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from clearspan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_leaves string, c int, id int"


def plain(rows, rebuild=True):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = dict(own)
    for c in own if rebuild else ():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, who in members.items():
        worth = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += worth
    out = []
    for path, who in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(path))).encode()).hexdigest()
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids[path], leaves[path], saved[path], ends))
    return sorted(out, key=str)


def family(seed, convs, most):
    r = np.random.default_rng(seed)
    rows = []
    for c in convs:
        for t in range(int(r.integers(1, most))):
            rows.append((int(c), t if r.random() > 0.1 else None, ["user", "assistant", None][int(r.integers(3))] if r.random() < 0.2 else "user", ["a b", "c", "", None, "d e f"][min(4, int(r.exponential(0.7)))]))
    return rows


@pytest.mark.parametrize(("limit", "rebuild", "convs"), [(3, True, range(-25, 120)), (20_000, False, [-40, -39, 5, 7, 2**40, 2**40 + 3])])
def test_plain(spark, limit, rebuild, convs):
    rows = family(3, convs, 9)
    rows += [(60, t, "user", "x y") for t in range(80)] + [(61, t, "user", "x y") for t in range(70)]  # long ones that share most
    rows += [(None, 1, "user", "lost"), (5, 2, "user", "again"), (5, 2, "user", "again"), (70, 0, "user", "long " * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df, limit=limit, rebuild=rebuild).collect()), key=str) == plain(rows, rebuild)


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_local_sums():
    """A random tree in preorder: sums of all values of a node's subtree."""
    r = np.random.default_rng(1)
    n = 400
    parent = np.array([-1] + [int(r.integers(max(0, k - 4), k)) for k in range(1, n)])
    kids = [[] for _ in range(n)]
    for k in range(1, n):
        kids[parent[k]].append(k)
    order, depth, size, stack = [], np.zeros(n, int), np.ones(n, int), [0]
    while stack:
        k = stack.pop()
        order.append(k)
        for x in kids[k]:
            depth[x] = depth[k] + 1
            stack.append(x)
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    node = np.empty(n, int)
    node[order] = np.arange(n)
    values = r.integers(0, 9, (n, 2))
    want = values.copy()
    for k in range(n - 1, 0, -1):
        want[parent[k]] += want[k]
    assert (prefix_trie.local_sums(np.zeros(n, int), node, size, size.copy(), depth, values) == want).all()
