"""Scans by the byte scanner's rules against a plain loop over the bytes, over files of many splits."""

import random
import re
from collections import Counter

import pytest

from regsync.sources import scan


@pytest.fixture
def splits(spark):
    """Splits of 64 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "16b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_relations(text, header=True):
    out = []
    for line in text.split("\n")[1 if header else 0 :]:
        if not line.strip():
            continue
        m = re.match(r"\s*(\d+);\s*(\d+)", line)
        if not m or int(m[1]) >= 2**63 or int(m[2]) >= 2**63:
            break
        out.append((int(m[1]), int(m[2])))
        if line[m.end() :].strip():
            break
    return Counter(out)


@pytest.mark.parametrize("bad", [None, "x;1", "5;", ";5", "7;8;9", "7 ;8", "99999999999999999999;1", "-"])
def test_relations_end_at_the_first_bad_line(spark, tmp_path, splits, bad):
    rng = random.Random(str(bad))
    lines = ["inst;course"] + [f"{rng.randrange(50)};{' ' * rng.randrange(2)}{rng.randrange(10**rng.randrange(1, 18))}" if rng.random() < 0.95 else "" for _ in range(300)]
    if bad is not None:
        for i in (170, 171, 260):  # several bad lines, in the middle of several splits
            lines[i] = bad
    path = tmp_path / "r.csv"
    path.write_text("\n".join(lines) + "\n")
    df = scan.scan_relations(spark, str(path))
    assert scan.ordered_lines(spark, str(path)).rdd.getNumPartitions() > 10
    assert Counter(map(tuple, df.collect())) == plain_relations("\n".join(lines))


def test_relations_of_a_folder_and_of_nothing(spark, tmp_path):
    assert scan.scan_relations(spark, str(tmp_path / "none.csv")).count() == 0
    rows = spark.range(1000).selectExpr("id", "IF(id = 700, 'bad', concat(id, ';', id + 1)) AS value")
    rows.orderBy("id").repartitionByRange(7, "id").sortWithinPartitions("id").select("value").write.text(str(tmp_path / "parts"))
    got = scan.scan_relations(spark, str(tmp_path / "parts"), header=False)
    assert sorted(r[0] for r in got.collect()) == list(range(700))
    (tmp_path / "empty.csv").write_text("")
    assert scan.scan_relations(spark, str(tmp_path / "empty.csv")).count() == scan.scan_institutions(spark, str(tmp_path / "empty.csv")).count() == 0


def plain_institutions(data: bytes):
    out, pieces = [], []
    for line in data.split(b"\n"):
        pieces += [line[i : i + scan.LINE] for i in range(0, max(1, len(line)), scan.LINE)]
    for piece in pieces[1:]:
        m = re.match(rb"\s*(\d+)", piece)
        if not m or int(m[1]) >= 2**63:
            continue
        fields, at, going = [], m.end(), True
        for i, (_, most) in enumerate(scan.FIELDS):
            value = b""
            if going and piece[at : at + 1] == b";":
                end = at + 1
                while end < len(piece) and end - at - 1 < most and (piece[end : end + 1] != b";" or i == len(scan.FIELDS) - 1):
                    end += 1
                value, at = piece[at + 1 : end], end
            going = going and value != b""
            fields.append(value.decode("utf-8", "replace"))
        out.append((int(m[1]), *fields))
    return Counter(out)


def test_institutions_by_the_bytes(spark, tmp_path, splits):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcé \"', ", k=n))
    lines = ["id;nome"]
    for i in range(120):
        fields = [word(rng.choice([0, 1, 5, 30])) if rng.random() < 0.9 else word(rng.choice([63, 64, 126, 128, 255, 256, 300, 520])) for _ in range(rng.randrange(8))]
        lines.append(rng.choice(["", " ", "x"]) * (rng.random() < 0.1) + ";".join([str(i), *fields]))
    lines += ["7;" + ";".join("f" * 60 for _ in range(300)), "8;a;b;c;d;e;home;page", "9", "", "nothing"]
    data = "\n".join(lines).encode()
    path = tmp_path / "i.csv"
    path.write_bytes(data)
    got = Counter(map(tuple, scan.scan_institutions(spark, str(path)).collect()))
    assert got == plain_institutions(data)
