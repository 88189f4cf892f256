"""One text scan gives header, encoding and rows per file, however it is split."""

from __future__ import annotations

import os

from ledgerlens.sources.csv import read_headers, scan

HEAD = "date,description,amount"
LINE = "2026-04-01,Cafe %05d,-3.00"


def write(root, name, data: bytes):
    with open(os.path.join(root, name), "wb") as fh:
        fh.write(data)


def test_headers_of_split_files(spark, tmp_path):
    body = "\n".join(LINE % i for i in range(4000)).encode()
    write(tmp_path, "long utf8.csv", b"\xef\xbb\xbf\n \t\n" + HEAD.encode() + b"\n" + body + "\n2026-04-02,Caf\u00e9,-1.00\n\n".encode())
    write(tmp_path, "long latin.csv", HEAD.encode() + b"\r\n" + body.replace(b"\n", b"\r\n") + b"\r\n2026-04-02,Caf\xe9,-1.00")
    write(tmp_path, "latin head.csv", b"date,description,amount,caf\xe9\n")
    write(tmp_path, "empty.csv", b"")
    write(tmp_path, "blank.csv", b"\n \n")
    write(tmp_path, "other.txt", b"date,description,amount\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = {"long utf8.csv": (HEAD, "UTF-8", 4001), "long latin.csv": (HEAD, "ISO-8859-1", 4001),
            "latin head.csv": (HEAD + ",caf\u00e9", "ISO-8859-1", 0), "blank.csv": ("", "UTF-8", 0)}
    try:
        for size in ("128m", "10k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {os.path.basename(r.path): (r.header, r.encoding, r.n_rows) for r in read_headers(spark, str(tmp_path)).collect()}
            assert got == want
        tx, rejects = scan(spark, str(tmp_path))
        assert tx.where("description = 'Caf\u00e9'").count() == 2 and tx.count() == 8002
        assert {os.path.basename(r.file_path) for r in rejects.collect()} == {"blank.csv", "latin%20head.csv"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_header_scan_has_no_python(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD.encode() + b"\n")
    plan = read_headers(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and plan.count("FileScan text") == 1
