import struct

import pytest

from plumbline.sources import ingest, spss
from plumbline.streaming import quality


def test_names():
    assert ingest.clean_names(["a b", "1x", "", "a", "a", "a_1", "şehir-adı"]) == ["a_b", "col_1x", "column", "a", "a_1", "a_1_1", "şehir_adı"]


def test_detection():
    assert ingest.detect_encoding(b"\xef\xbb\xbfa") == "utf-8-sig" and ingest.detect_encoding(b"\xff\xfea\0") == "utf-16-le"
    assert ingest.detect_encoding("şehir".encode()) == "utf-8" and ingest.detect_encoding("şehir;il".encode("cp1254")) == "windows-1254"
    assert ingest.detect_delimiter("a;b;c\n1;2;3\n") == ";" and ingest.detect_delimiter("a|b\n1|2\n") == "|"


def test_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('id;name;amount\n1;"a;b";1.250,50\n2;N/A;3.000,25\n3;c;2.500,75;too long\n4;d\n5;-;x\n', encoding="utf-8")
    df, meta = ingest.load_file(spark, str(f))
    rows = {r["id"]: (r["name"], r["amount"]) for r in df.collect()}
    assert rows == {1.0: ("a;b", 1250.5), 2.0: (None, 3000.25), 4.0: ("d", None), 5.0: (None, None)}
    assert meta["delimiter"] == ";" and meta["tr_number_columns"] == ["amount"]
    with pytest.raises(FileNotFoundError):
        ingest.load_file(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError):
        ingest.load_file(spark, str(tmp_path / "no.doc"))


def test_turkish_code_page(spark, tmp_path):
    f = tmp_path / "tr.csv"
    f.write_bytes("ad,il\nİsmail,Iğdır\nŞule,Muş\n".encode("cp1254"))
    df, meta = ingest.load_file(spark, str(f))
    assert meta["encoding"] == "windows-1254" and sorted(r["ad"] for r in df.collect()) == ["İsmail", "Şule"]


def test_number_gate(spark):
    df = spark.createDataFrame([(i, "1.250,50" if i < 15 else "abc") for i in range(50)], "i int, s string")
    assert ingest.tr_number_columns(df, "i") == ["s"]
    assert ingest.tr_number_columns(df.where("i > 1"), "i") == []


def sav(packed: bool) -> bytes:
    head = b"$FL2" + b"x" * 60 + struct.pack("<iiiii", 2, 3, int(packed), 0, 2) + struct.pack("<d", 100.0) + b"01 Jan 20" + b"00:00:00" + b" " * 64 + b"\0" * 3
    var = lambda name, width, label: struct.pack("<iiiiii", 2, width, int(bool(label)), 0, 0, 0) + name.ljust(8).encode() + (struct.pack("<i", len(label)) + label.ljust((len(label) + 3) // 4 * 4).encode() if label else b"")
    dictionary = var("AGE", 0, "Age in years") + var("NAME", 10, "") + struct.pack("<iiiiii", 2, -1, 0, 0, 0, 0) + b" " * 8
    labels = struct.pack("<ii", 3, 1) + struct.pack("<d", 1.0) + b"\x03one" + b" " * 4 + struct.pack("<iii", 4, 1, 1)
    end = struct.pack("<ii", 999, 0)
    if packed:
        body = bytes([101, 253, 254, 255, 253, 253, 252, 0]) + b"Ada     " + b"Wilhelmi" + b"na      "
    else:
        body = struct.pack("<d", 1.0) + b"Ada     " + b" " * 8 + struct.pack("<d", -1.7976931348623157e308) + b"Wilhelmi" + b"na      "
    return head + dictionary + labels + end + body


@pytest.mark.parametrize("packed", [False, True])
def test_sav(spark, packed):
    df, meta = spss.read_sav(spark, sav(packed))
    assert [tuple(r) for r in df.collect()] == [(1.0, "Ada"), (None, "Wilhelmina")]
    assert meta["variable_labels"]["AGE"] == "Age in years" and meta["value_labels"]["AGE"] == {"1": "one"}
    assert df.schema["AGE"].metadata["label"] == "Age in years"
    bad, meta = spss.read_sav(spark, b"nonsense")
    assert bad.count() == 0 and meta["warnings"]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "e"))
    flagged = quality.flag_outliers(quality.normalize_stream(stream, ["event_type"], ("turkish_upper",)), "value", 0, 100)
    q = flagged.writeStream.format("memory").queryName("flagged").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert spark.sql("select count(*) from flagged where is_outlier").first()[0] == batch.where("value > 100").count()
    for name, df in (("profiled", quality.windowed_profile(stream, "value", "ts", "1 hour")), ("digits", quality.benford_stream(stream, "value", "ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(n) from profiled").first()[0] == batch.count()
    assert spark.sql("select sum(count) from digits").first()[0] == batch.where("value > 0").count()


def test_line_breaks_in_quotes_far_down(spark, tmp_path):
    f = tmp_path / "far.csv"
    f.write_text("id,note\n" + "".join(f"{i},plain\n" for i in range(30_000)) + '30000,"two\nlines"\n30001,"a ""quoted"" word"\n', encoding="utf-8")
    df, _ = ingest.read_csv(spark, str(f))
    assert df.count() == 30_002 and {r["note"] for r in df.where("id >= '30000' and length(id) = 5 and id > '3'").where("note <> 'plain'").collect()} == {"two\nlines", 'a "quoted" word'}
    g = tmp_path / "tr.csv"
    g.write_bytes('ad,il\n"İki\nsatır",Iğdır\n'.encode("cp1254"))
    with pytest.raises(ValueError):
        ingest.load_file(spark, str(g))
    with pytest.raises(ValueError):
        ingest.whole_file(spark, str(f), 1000)
