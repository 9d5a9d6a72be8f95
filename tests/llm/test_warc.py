import hashlib
import io
import random
import zipfile

import duckdb
import pytest

from quarrylens.llm.warc import OP6_SQL, ZipReader, op6_warc, package, parse, read_archives, records, render, write_archives


def reader(data):
    return lambda at, n: data[at : at + n]


def test_reader_finds_stored_members_of_any_zip():
    rnd = random.Random(7)
    for wide in (False, True):
        for note in (b"", b"PK\5\6 a note that looks like an end" * 3):
            out = io.BytesIO()
            out.write(b"junk in front" * wide)
            want = {}
            with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED) as z:
                for i in range(30):
                    want[f"dir/ü{i}.bin"] = rnd.randbytes(rnd.randint(0, 500))
                    with z.open(zipfile.ZipInfo(f"dir/ü{i}.bin"), "w", force_zip64=wide) as f:
                        f.write(want[f"dir/ü{i}.bin"])
                z.comment = note
            data = out.getvalue()
            z = ZipReader(reader(data), len(data))
            assert set(z.members) == set(want)
            for name, body in want.items():
                at, n = z.stored(name)
                assert data[at : at + n] == body


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(9):
            z.writestr(f"{i}", str(i) * i)
    data = out.getvalue()
    assert b"PK\6\6" in data
    z = ZipReader(reader(data), len(data))
    assert [data[a : a + n] for a, n in (z.stored(str(i)) for i in range(9))] == [(str(i) * i).encode() for i in range(9)]


def test_broken_files_are_refused():
    for data in (b"", b"nothing here", package([("x", b"")])[:-30]):
        with pytest.raises(ValueError):
            ZipReader(reader(data), len(data))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "a" * 99)
    with pytest.raises(ValueError):
        ZipReader(reader(out.getvalue()), len(out.getvalue())).stored("a")


def test_records_are_read_by_range():
    import gzip

    bodies = [b"", b"x" * 5000, "é\r\n\r\n".encode()]
    raw = [render("response", i, "http://a/b\r\nX: y", b, hashlib.sha256(b).hexdigest(), len(b), None) for i, b in enumerate(bodies)]
    data = package([(str(i), gzip.compress(r)) for i, r in enumerate(raw)])
    asked = []
    got = list(records(lambda at, n: asked.append(n) or data[at : at + n], len(data), most=100))
    assert [r["payload"] for r in got] == bodies and "x" not in got[0]
    assert parse(raw[2])["x-page-id"] == "2" and len(asked) > 5


def test_whole_table_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(OP6_SQL).fetchall()
    assert sorted(map(tuple, op6_warc(spark, sf).collect()), key=str) == sorted(want, key=str)


def test_edge_cases(spark, tmp_path):
    long = "z" * 120
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (4, "u", long), (4, "u", long), (None, "u", long), (7, "u\nv", "é" * 300_000), (8, "u", "short"), (9, "u", "short"), (None, "u", "w" * 200), (None, "u", "w" * 200)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, size int")
    got = read_archives(write_archives(df, f"file://{tmp_path}/a")).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", 0, "response", None), ("2", 0, "response", None), ("3", 120, "response", None), ("4", 120, "revisit", 3), ("4", 120, "revisit", 3), ("None", 120, "revisit", 3), ("7", 600_000, "response", None), ("8", 5, "response", None), ("9", 5, "response", None), ("None", 200, "response", None), ("None", 200, "response", None)], key=str)
    assert read_archives(write_archives(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def foreign(index, gz_index=False, deflate=False, plain=False):
    """An archive of somebody else: two data members, one index or none."""
    import gzip
    import json

    out, want, lines = io.BytesIO(), [], []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in ("one.warc.gz", "two.warc.gz"):
            name = name.removesuffix(".gz") if plain else name
            body = b""
            for i in range(7):
                payload = f"{name} {i} ".encode() * (i * 900 + 1)
                raw = render("response", i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)
                part = raw if plain else gzip.compress(raw)
                want.append(payload)
                if index == "cdxj":
                    lines.append(f"com,x)/{i} 2020 " + json.dumps({"filename": name, "offset": str(len(body)), "length": str(len(part)), "url": "u"}))
                elif index == "cdx":
                    lines.append(f"com,x)/{i} 2020 http://x/{i} text/html 200 ABC - - {len(part)} {len(body)} {name}")
                elif index == "short":
                    lines.append(f"com,x)/{i} 2020 " + json.dumps({"filename": f"archive/{name}", "offset": len(body)}))
                body += part
            z.writestr(f"archive/{name}", body)
        z.writestr("pages/pages.jsonl", '{"format": "json-pages-1.0"}\n')
        if index:
            head = " CDX N b a m s k r M S V g\n" if index == "cdx" else '!meta {"format": "cdxj"}\n'
            raw = (head + "\n".join(sorted(lines)) + "\n").encode()
            name = f"indexes/index.{'cdx' if index == 'cdx' else 'cdxj'}" + ".gz" * gz_index
            z.writestr(name, gzip.compress(raw) if gz_index else raw, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)
    return out.getvalue(), want


@pytest.mark.parametrize("index, more", [("cdxj", {}), ("cdxj", {"gz_index": True}), ("cdxj", {"deflate": True}), ("cdx", {}), ("short", {}), (None, {}), (None, {"plain": True}), ("cdxj", {"plain": True})])
def test_archives_of_others(index, more, monkeypatch):
    from quarrylens.llm import warc

    data, want = foreign(index, **more)
    for piece in (1 << 20, 257):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert sorted(r["payload"] for r in records(reader(data), len(data))) == sorted(want)
    if index:
        asked = []
        list(records(lambda at, n: asked.append(n) or data[at : at + n], len(data), most=1))
        # after the end of the file, which holds the directory, and the index
        assert max(asked[4:]) < len(data) // 2


def test_own_archives_are_described():
    import json

    data = package([("urn:a", b"123"), ("urn:b", b"4567")])
    z = ZipReader(reader(data), len(data))
    about = json.loads(z.whole("datapackage.json"))
    for x in about["resources"]:
        body = z.whole(x["path"])
        assert (x["bytes"], x["hash"]) == (len(body), "sha256:" + hashlib.sha256(body).hexdigest())
    assert [json.loads(line.split(" ", 2)[2])["offset"] for line in z.whole("indexes/index.cdxj").decode().splitlines()] == ["0", "3"]


def test_archives_are_deleted_with_the_rest(spark, sf):
    from pathlib import Path

    from quarrylens.llm.common import shared_dir
    from quarrylens.operators import lineage

    folder = Path(shared_dir(spark).removeprefix("file://")) / "quarrylens"
    before = set(folder.glob("archives-*"))
    assert op6_warc(spark, sf).count() > 0
    new = set(folder.glob("archives-*")) - before
    assert len(new) == 1 and list(next(iter(new)).glob("*.wacz"))
    lineage.clean(spark)
    assert not new & set(folder.glob("archives-*"))
