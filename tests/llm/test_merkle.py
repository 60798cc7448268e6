import hashlib
import random
import zlib

import pytest

from rillflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The last node, and the siblings of each first node by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            proofs[k].append((run, a % 8))
            at[k] = a // 8
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, proof in zip(own[x], trees[x][1], strict=True):
            i, *_, text = r
            low = "".join(c.lower() if c.isascii() else c for c in text) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else text
            up, siblings = leaf((*r[:-1], low)), ""
            for run, place in proof + tops[k]:
                siblings += "".join(run[:place] + run[place + 1 :])
                up = sha(*run[:place], up, *run[place + 1 :])
            out.append((i, leaf(r), trees[x][0], root, sha(siblings), up, up == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("langs", [[None, "en"], ["en"], [f"l{k}" for k in range(70)] + [None, "é", "Z", "z"]])
def test_manifest_against_brute_force(spark, langs):
    draw = random.Random(len(langs))
    rows = [(draw.randrange(400), draw.choice(["a", None]), draw.choice(langs), draw.choice([3, None]), draw.choice(["Ab C", "abc", "", None, "É Ü x", f"T{k}"])) for k in range(600)]
    rows += [rows[0], rows[0], (None, "s", langs[0], 1, "NULL"), (None, "s", langs[0], 1, "NULL"), (3, "s", langs[-1], 9, "W" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", leaf int, tree int").repartition(5)
    got = merkle.dataset_manifest(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_small_tables(spark):
    assert merkle.dataset_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(1, "s", None, 2, "x")], [(0, "s", "en", 2, "X"), (1, "s", "fr", 2, "Y")]):
        assert sorted(map(tuple, merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_row_limit_of_recursion_is_put_back(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    merkle.dataset_manifest(spark.createDataFrame([(1, "s", None, 2, "x")], SCHEMA))
    assert spark.conf.get(key, None) == before
