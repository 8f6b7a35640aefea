"""Quoted files read by many tasks, against the built-in reader with one task per file."""

import gzip
import random

import pyarrow as pa
import pytest

from tagwright.sources import listings as src
from tagwright.sources import quoted
from tagwright.sources.shared import fresh_path, spread
from tagwright.streaming.scoring import scan_chunked

def cut(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


HEADER = "\t".join(f.name for f in src.LISTING)


@pytest.fixture(params=[3000, 1 << 27])
def ranges(spark, request):
    """Files are cut into ranges of so many bytes."""
    cut(spark, request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def built_in(spark, path):
    return spark.read.options(**src.tsv_options()).schema(src.LISTING).csv(path)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def written(spark):
    """Our own writer's files: newlines, tabs and quotes within fields, one record longer than many
    ranges, nulls, empty texts."""
    rnd = random.Random(2)
    bits = ["a", "\n", '"', "\t", "word ", "é", "\n\n", '""', "\r", "NA"]
    field = lambda n: "".join(rnd.choices(bits, k=rnd.randrange(n)))
    made = [(f"id{i}", "train", field(6), field(9) or None, None, field(30), i % 5, 1, i / 4) for i in range(400)]
    made[200] = (*made[200][:5], 'long\n"q"\t\n' * 900, 3, 1, 1.0)
    path = fresh_path(spark, "written")
    return src.write_listings(spark.createDataFrame(made, src.LISTING).coalesce(2), path), len(made)


def test_same_rows_as_one_task(spark, written, ranges):
    path, n = written
    read = quoted.read_quoted(spark, path, src.LISTING, src.tsv_options())
    assert rows(read) == rows(built_in(spark, path)) and read.count() == n
    if ranges < 10_000:
        found = quoted.ranges(spark, [path], "\t")
        assert found.count() > 10 and quoted.inside_ranges(found).count() > 2


FILES = {
    "no end of line": HEADER + "\na\ttrain\tb\tc\td\te\t1\t0\t2.5",
    "windows": HEADER + '\r\na\ttrain\t"x\r\ny"\tc\td\te\t1\t0\t2.5\r\nb\ttest\tn\t\t\t\t\t\t\r\n',
    "empty lines": HEADER + "\n\na\ttrain\tb\tc\td\te\t1\t0\t2.5\n\n\nb\ttest\tn\tc\td\te\t1\t0\t1\n",
    "header only": HEADER + "\n",
    "header without end": HEADER,
    "nothing": "",
    "quotes within fields": HEADER + '\na\ttrain\t5" wide\t6"\t"7"" deep"\tthe "best" one\t1\t0\t2.5\nb\ttest\ta "\tb\tc\td\t1\t1\t1\n',
    "quoted newline first": HEADER + '\n"a\n1"\ttrain\t"\n"\t"\n\n"\t"d"\t"e\n"\t1\t0\t2.5\n' * 1,
}


@pytest.mark.parametrize("name", FILES)
def test_odd_files(spark, tmp_path, ranges, name):
    cut(spark, 50 if ranges < 10_000 else ranges)
    for packed in (False, True):
        file = tmp_path / ("f.tsv.gz" if packed else "f.tsv")
        data = FILES[name].encode()
        file.write_bytes(gzip.compress(data) if packed else data)
        got = src.read_listings(spark, str(file), spellings=[])
        want = built_in(spark, str(file))
        if name == "windows":  # line ends within a field stay as they are
            want = want.replace({"x\ny": "x\r\ny"})
        assert rows(got) == rows(want)


def test_rule_of_quotes():
    rule = quoted.Quotes("\t")
    cases = {"": False, "a": False, '"a': True, '"a"': False, '"a""': True, 'a"b': False, '"a"\t"b': True, '"a"b\tc': False,
             'x\t"y\tz': True, '"': True, '""': False, '"""': True, 'a\t""\tb"': False, '"a"b"\t"c': True}
    inside = {"": True, '"': False, 'a""b': True, 'a"\t"b': True, 'a"\tb': False, '""': True, 'a"b"\tc': False}
    for start, want in ((False, cases), (True, inside)):
        assert dict(zip(want, rule.ends_inside(pa.array(list(want)), start).tolist())) == want


@pytest.mark.parametrize("files", [1, 2, 5])
def test_chunks_hold_every_row_once(spark, written, files):
    path, n = written
    copied = spark.read.schema(src.LISTING).parquet(f"{scan_chunked(spark, path, files)}/chunk=*")
    assert rows(copied) == rows(src.read_listings(spark, path)) and copied.count() == n


def test_only_small_tables_are_spread(spark, written):
    path, _ = written
    df = src.read_listings(spark, path)
    assert spread(df, path, "listing_id", limit=1) is df
    plan = spread(df, path, "listing_id")
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString() and rows(plan) == rows(df)


def test_only_pieces_of_cut_records_are_written(spark, written, ranges, monkeypatch):
    path, _ = written
    kept, publish = {}, quoted.publish
    monkeypatch.setattr(quoted, "publish", lambda df, label: kept.setdefault(label, publish(df, label)))
    read = quoted.records(spark, path, "\t").count()
    parts = kept.get("quoted-parts")
    assert parts is not None or ranges > 10_000
    if parts is not None:
        assert 0 < parts.select("file", "owner").distinct().count() < read / 2 and parts.where("owner IS NULL").isEmpty()


def test_packed_files_hold_few_rows(spark, written, monkeypatch, tmp_path):
    monkeypatch.setattr(src, "PACKED_ROWS", 90)
    rows_of = src.read_listings(spark, written[0], spellings=[])
    packed = src.write_listings(rows_of.coalesce(1), str(tmp_path / "packed"), packed=True)
    files = list((tmp_path / "packed").glob("*.csv.gz"))
    assert len(files) == 5 and len(list((tmp_path / "packed").glob("*.csv"))) == 0
    assert rows(src.read_listings(spark, packed, spellings=[])) == rows(rows_of)
