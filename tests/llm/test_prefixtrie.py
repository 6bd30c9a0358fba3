import hashlib
import math
import random
import zlib

import pytest

from partloom.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn int, role string, text string"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def brute(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            conv.setdefault(c, []).append(((t is not None, t or 0), mark, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, kids = {}, {}
    for c, v in rebuilt.items():
        for k in range(len(v) + 1):
            nodes.setdefault(tuple(v[:k]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


def sample(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -5, -100, -250, None]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é\U0001f600", "", None])))
    for t in range(80):
        rows += [(5000, t, "u", "x"), (5001, t, "u", "x" if t < 70 else "y"), (5001, 3, "u", "x")]
    return rows


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(queries.op11_conversation_trie(spark, sf).collect()) == brute(rows)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_nulls_ties_repeats_and_shared_beginnings(spark, parts):
    rows = sample(parts, 700)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS n", "3 AS own", "4 AS depth")
    assert ordered(prefixtrie.trie(prefixtrie.rebuilt(df), parts).collect()) == brute(rows)


@pytest.mark.parametrize("many", [1, 3, 50])
def test_groups_of_items_and_ranges_do_not_matter(many):
    """Peeling in one range and group gives the nodes of peeling in three ranges, group by group, and then their borders."""
    rng = random.Random(many)
    texts = [tuple(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    by = {}
    for c, t in enumerate(texts):
        key, path = b"", b""
        for x in t:
            key = hashlib.sha256(key + x.encode()).digest()[: prefixtrie.KEY]
            path += key + (1).to_bytes(8, "big")
        by.setdefault(path, []).append(c)
    items = [(p, [{"depth": len(p) // prefixtrie.STEP, "n": len(m), "low": min(m), "children": 0, "leaves": 0, "saved": 0, "ends": str(m), "asked": False}]) for p, m in sorted(by.items())]

    def nodes(found):
        low = {n["own"]: n["conv_id"] for n in found}
        return sorted((n["own"], n["conv_id"], low[n["waits"]] if n["waits"] is not None else n["parent_conv_id"], n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], n["ends_sha256"]) for n in found)

    want = nodes([n for out, _ in prefixtrie.peel(iter(items), True) for n in out])
    cut = len(items) // 3
    found, borders = [], []
    for part in (items[:cut], items[cut : 2 * cut], items[2 * cut :]):
        for out, rest in prefixtrie.peel(iter(part), False, many):
            found += out
            borders += [(b["path"], b["sums"]) for b in rest]
    assert len(borders) <= 6
    found += [n for out, _ in prefixtrie.peel(iter(sorted(borders, key=lambda b: b[0])), True, many) for n in out]
    assert nodes(found) == want and len(want) > 100


def test_one_very_common_conversation_is_hashed_in_pieces(spark):
    """More copies than a piece holds, spread over all ranges; none of them in a list."""
    df = spark.range(9500).selectExpr("id AS conv_id", "0 AS turn", "'u' AS role", "'same' AS text")
    got = prefixtrie.trie(prefixtrie.rebuilt(df), 8).collect()
    assert ordered(got) == brute([(c, 0, "u", "same") for c in range(9500)])


def test_deep_conversation(spark):
    rows = [(c, t, "u", "x") for c in (100, 200) for t in range(3000)]
    got = ordered(prefixtrie.trie(prefixtrie.rebuilt(spark.createDataFrame(rows, SCHEMA)), 4).collect())
    assert len(got) == 3001 and all(r[3] == 2 for r in got) and got[0][4] == 1


def test_empty_table(spark):
    assert prefixtrie.trie(prefixtrie.rebuilt(spark.createDataFrame([], SCHEMA))).collect() == []
