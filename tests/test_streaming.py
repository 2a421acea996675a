import uuid

from pyspark.sql import functions as F

from ledgerline.operators.runlog import RunLog
from ledgerline.sources import schemas as S
from ledgerline.sources import testdata
from ledgerline.sources.store import TableStore
from ledgerline.streaming import microbatch as MB

from conftest import SF_SMALL


def test_payment_stream_is_replay_safe(spark, tmp_root):
    root = f"{tmp_root}/{uuid.uuid4().hex}"
    src = testdata.source_tables(spark, SF_SMALL)
    cut = F.lit(testdata.SNAPSHOT_CUTOFF).cast("date")
    wh = TableStore(spark, f"{root}/wh")
    static = {k: v for k, v in src.items() if k != "payments"}
    for i, part in enumerate((F.col("payment_date") < cut, F.col("payment_date") >= cut)):
        MB.land(src["payments"].where(part), f"{root}/landing", f"part={i}")
        MB.payment_stream(spark, f"{root}/landing", S.PAYMENTS, wh, static, f"{root}/ckpt").awaitTermination()
    assert wh.read("fact_payments").count() == 5572
    runs = RunLog(spark, wh.root).runs().orderBy("run_id").collect()
    assert [(r.batch_id, r.status) for r in runs] == [(0, "success"), (1, "success")]
    # restart on the same checkpoint with the same files: no new batch, no new rows
    q2 = MB.payment_stream(spark, f"{root}/landing", S.PAYMENTS, TableStore(spark, f"{root}/wh"),
                           static, f"{root}/ckpt")
    q2.awaitTermination()
    assert TableStore(spark, f"{root}/wh").read("fact_payments").count() == 5572
    # the same file landed again under a new name: insert-if-absent keeps the facts unchanged
    MB.land(src["payments"].where(F.col("payment_date") < cut), f"{root}/landing", "part=2")
    q3 = MB.payment_stream(spark, f"{root}/landing", S.PAYMENTS, TableStore(spark, f"{root}/wh"),
                           static, f"{root}/ckpt")
    q3.awaitTermination()
    last = RunLog(spark, wh.root).runs().orderBy(F.col("run_id").desc()).first()
    assert last.payments_inserted == 0
    assert TableStore(spark, f"{root}/wh").read("fact_payments").count() == 5572
