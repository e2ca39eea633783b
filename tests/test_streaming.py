"""The cleaning operators run unchanged on a file stream; files land once."""

from ledgerlens.streaming.ledger_stream import start_ledger_stream


def test_ledger_stream_appends_clean_rows_once(spark, tmp_path):
    src = tmp_path / "exports"
    src.mkdir()
    (src / "Penjualan_Shopee_1.csv").write_text(
        "Kode Nota,Tanggal,Deskripsi Brg,Jenis Barang,Jml\n"
        "N1,2024-01-02, Bor ,PT,2.9\nN2,31/31/2020,Gergaji,PT,1\nN3,2024-01-03,Baut,BAUT,x\n")
    table, ckpt = str(tmp_path / "sales"), str(tmp_path / "ckpt")
    start_ledger_stream(spark, str(src), table, ckpt, "Shopee").awaitTermination()
    first = spark.read.parquet(table).collect()
    assert [(r.kode_nota, r.deskripsi_brg, r.jml, r.platform) for r in first] == [("N1", "Bor", 2, "Shopee")]
    # a restart with no new file adds nothing
    start_ledger_stream(spark, str(src), table, ckpt, "Shopee").awaitTermination()
    assert spark.read.parquet(table).count() == 1


def test_ledger_stream_default_checkpoint_survives_restart(spark, tmp_path):
    """Without an explicit checkpoint the stream keeps its progress under the
    session's checkpoint folder, so a second run adds no row twice."""
    src = tmp_path / "exports"
    src.mkdir()
    (src / "Penjualan_Tokopedia_1.csv").write_text(
        "Kode Nota,Tanggal,Deskripsi Brg,Jenis Barang,Jml\nT1,2024-02-02,Selang,PT,3\n")
    table = str(tmp_path / "sales")
    start_ledger_stream(spark, str(src), table, None, "Tokopedia").awaitTermination()
    start_ledger_stream(spark, str(src), table, None, "Tokopedia").awaitTermination()
    assert spark.read.parquet(table).count() == 1
