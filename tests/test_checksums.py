from __future__ import annotations

import hashlib
import random
import tracemalloc
from datetime import date, datetime

import pytest

from lakemill.sources import checksums, ingest
from tests.test_ingest import landed


def tree(content: bytes, leaf: int, node: int = checksums.NODE) -> str:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    if len(content) <= leaf:
        return sha(content)
    leaves = [sha(content[i : i + leaf]) for i in range(0, len(content), leaf)]
    nodes = [sha("".join(leaves[i : i + node]).encode()) for i in range(0, len(leaves), node)]
    return sha("".join(nodes).encode())


def test_trees_equal_a_plain_reckoning(spark, tmp_path):
    rng, leaf = random.Random(5), 7
    sizes = [0, 1, 6, 7, 8, 14, 15, 300, 7 * checksums.NODE, 7 * checksums.NODE + 1, 20_000]
    contents = {f"{n} é%20.parquet": rng.randbytes(n) for n in sizes}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"no landing file")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in checksums.checksums(checksums.listed(spark, str(tmp_path)), leaf).collect()}
    assert got == {name: (len(content), tree(content, leaf)) for name, content in contents.items() if content}


def test_a_file_of_more_than_two_gigabytes_is_proved_piece_by_piece(spark, tmp_path):
    size, path = (2 << 30) + 300_000_007, tmp_path / "large.parquet"
    with path.open("wb") as file:
        file.truncate(size)
        file.seek(size - 5)
        file.write(b"end")
    prove = lambda: checksums.checksums(checksums.listed(spark, str(tmp_path))).collect()
    row = prove()[0]
    zeros, pieces = bytes(checksums.PIECE), []
    for start in range(0, size, checksums.LEAF):
        digest, left = hashlib.sha256(), min(checksums.LEAF, size - start)
        tail = b"\0\0\0\0\0"[:0] if start + left < size else b"end\0\0"
        for at in range(0, left - len(tail), checksums.PIECE):
            digest.update(zeros[: min(checksums.PIECE, left - len(tail) - at)])
        digest.update(tail)
        pieces.append(digest.hexdigest())
    node = hashlib.sha256("".join(pieces).encode()).hexdigest()
    assert (row["bytes"], row["sha256"]) == (size, hashlib.sha256(node.encode()).hexdigest())
    with path.open("r+b") as file:
        file.seek(size - 100_000_000)
        file.write(b"\1")
    assert prove()[0]["sha256"] != row["sha256"]


def test_a_range_is_held_piece_by_piece(tmp_path):
    path = tmp_path / "f"
    with path.open("wb") as file:
        file.truncate(20 * checksums.PIECE)
    tracemalloc.start()
    checksums.range_digest(f"file:{path}", 5, 20 * checksums.PIECE - 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * checksums.PIECE
    with pytest.raises(OSError, match="ends"):
        checksums.range_digest(str(path), 0, 20 * checksums.PIECE + 1)


def test_landing_files_beyond_a_leaf_are_proved(spark, tmp_path, monkeypatch):
    day, root = date(2026, 1, 2), f"file://{tmp_path}/landing"
    monkeypatch.setattr(ingest, "LEAF", 100)
    manifest = landed(spark, root, [datetime(2026, 1, 2)] * 3)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert ingest.verify_landing(spark, root, manifest, "payments", day).count() == 0
    assert ingest.verify_landing_days(spark, root, manifest, "payments").count() == 0
    folder = tmp_path / "landing/payments" / f"dt={day}"
    written = {f.name: f for f in folder.glob("*.parquet")}
    assert {r["file"]: r["sha256"] for r in manifest.collect()} == {name: tree(f.read_bytes(), 100) for name, f in written.items()}
    file = written[manifest.first()["file"]]
    # A byte of a leaf in the middle, far from what a reader of Parquet looks at first.
    content = bytearray(file.read_bytes())
    content[150] ^= 1
    file.write_bytes(bytes(content))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert [r["problem"] for r in ingest.verify_landing(spark, root, manifest, "payments", day).collect()] == ["changed file"]
