from ledgerline import cli
from ledgerline.sources import testdata
from ledgerline.sources.store import TableStore

from conftest import SF_SMALL


def test_cli_load_export_restore_history(spark, tmp_root, capsys):
    src = testdata.source_tables(spark, SF_SMALL)
    for t, df in src.items():
        df.write.parquet(f"{tmp_root}/src/{t}")
    assert cli.main(["load", "--source", f"{tmp_root}/src", "--store", f"{tmp_root}/wh",
                     "--run-ts", "2030-01-01 00:00:00"]) == 0
    assert TableStore(spark, f"{tmp_root}/wh").read("fact_payments").count() == 5572
    assert cli.main(["export", "--store", f"{tmp_root}/wh", "--snapshots", f"{tmp_root}/snap",
                     "--label", "s1"]) == 0
    assert cli.main(["restore", "--snapshots", f"{tmp_root}/snap", "--label", "s1",
                     "--store", f"{tmp_root}/restored"]) == 0
    assert TableStore(spark, f"{tmp_root}/restored").read("fact_loans").count() == 1394
    assert cli.main(["history", "--store", f"{tmp_root}/wh"]) == 0
    assert "success" in capsys.readouterr().out
