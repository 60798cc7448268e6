import base64
import hashlib

from rillflow.llm import warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_revisits_against_brute_force(spark, tmp_path):
    rows = [(5, "u", "a"), (3, "u\r\nx: y", "a"), (4, None, None), (9, "", ""), (7, "é ü", "line\r\n\r\nWARC/1.1\r\n"), (3, "u", "a"), (None, "u", "a"), (None, "u", "only"), (11, "u", "x" * 300_000)]
    rows += [(100 + i, "u", "hot") for i in range(500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string")
    got = warc.deduplicated(df, str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_min_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.deduplicated(df, str(tmp_path / "w"), min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.deduplicated(df, str(tmp_path / "w")).count() == 0
