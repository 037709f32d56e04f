"""Split, sample and allocation queries."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.operators import sampling as sm
from fedtab.spec import PartitionPlan, TableSpec

from . import base as b

PLAN = PartitionPlan()
EVENT_SPEC = TableSpec(features=("value",), key=("event_id",), label="event_type")


def train_pool(spark, d):
    return sm.stratified_holdout(fx.txn(spark, d), fx.SPEC, 0.2, 42)


def seeded_rank(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "event_type")
    return sm.seeded_rank(ev, ["event_type"], ["event_id"], 42)


def stratified_holdout(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "event_type")
    return sm.stratified_holdout(ev, EVENT_SPEC, 0.2, 7)


def transaction_holdout(spark, d):
    return (train_pool(spark, d).groupBy("split", "label")
            .agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum")))


def quantity_skew_allocation(spark, d):
    neg = fx.txn(spark, d).filter("label = 0")
    return (sm.quantity_skew(neg, fx.SPEC, PLAN).groupBy("client")
            .agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"),
                 F.sum("l_linenumber").cast("bigint").alias("line_sum")))


def _shares(spark):
    return sm.share_table(spark, b.SHARE_VALUES, PLAN)


def rounded_counts(spark, d):
    n = fx.positives(spark, d).count()
    return sm.argmax_counts(_shares(spark), n).select("client", "cnt")


def capped_allocation(spark, d):
    n = fx.positives(spark, d).count()
    return sm.capped_counts(sm.argmax_counts(_shares(spark), n), 15).select("client", "cnt")


def partitioned(spark, d):
    return sm.holdout_and_shards(fx.txn(spark, d), fx.SPEC, PLAN, 0.2, b.SHARE_VALUES)


def non_iid_shards(spark, d):
    return partitioned(spark, d).filter("split = 'train'").drop("split")


def non_iid_partition(spark, d):
    """The two steps one after the other; non_iid_shards does both in one assignment."""
    pool = train_pool(spark, d).filter("split = 'train'").drop("split")
    return (sm.non_iid_partition(pool, fx.SPEC, PLAN, b.SHARE_VALUES).groupBy("client", "label")
            .agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"),
                 F.sum("l_partkey").alias("part_sum")))


def holdout_and_shards(spark, d):
    return partitioned(spark, d).select(*fx.KEY, "label", "split", "client")


def holdout_sample_row(spark, d):
    held = train_pool(spark, d).filter("split = 'holdout'")
    return sm.random_row(held, fx.SPEC, 42)


def synthetic_volume_target(spark, d):
    pos = fx.positives(spark, d).groupBy("client").agg(F.count("*").alias("n_pos"))
    return sm.synthetic_targets(pos, 0.75)


QUERIES = {f.__name__: f for f in (
    seeded_rank, stratified_holdout, transaction_holdout, quantity_skew_allocation, rounded_counts,
    capped_allocation, non_iid_partition, holdout_and_shards, holdout_sample_row, synthetic_volume_target)}

SQL = {
    "seeded_rank": """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
        ORDER BY md5(concat_ws('|', '42', event_id)), event_id) AS rank FROM events""",
    "stratified_holdout": """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
      e AS (SELECT *, ceil(0.2::DOUBLE * sum(n) OVER ()) AS t,
                   n * ceil(0.2::DOUBLE * sum(n) OVER ()) / sum(n) OVER () AS x FROM c),
      q AS (SELECT event_type, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, event_type)
                   <= t - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM e),
      r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
                   ORDER BY md5(concat_ws('|', '7', event_id)), event_id) AS rank FROM events)
      SELECT event_id, event_type, CASE WHEN rank <= quota THEN 'holdout' ELSE 'train' END AS split
      FROM r JOIN q USING (event_type)""",
    "transaction_holdout": f"""WITH {b.holdout()} SELECT split, label, count(*) AS n,
        sum(l_orderkey)::BIGINT AS key_sum FROM split GROUP BY ALL""",
    "quantity_skew_allocation": f"""WITH {b.TXN}, neg AS (SELECT * EXCLUDE (client) FROM txn WHERE label = 0),
      r AS ({b.ranked('neg', 'label', 42)}), c AS ({b.weighted("SELECT count(*) FROM neg")}),
      g AS (SELECT client, sum(cnt) OVER (ORDER BY pos) - cnt AS lo, sum(cnt) OVER (ORDER BY pos) AS hi FROM c)
      SELECT client, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum, sum(l_linenumber)::BIGINT AS line_sum
      FROM r JOIN g ON rank > lo AND rank <= hi GROUP BY client""",
    "rounded_counts": f"""WITH {b.POS} SELECT client, cnt::BIGINT AS cnt
        FROM ({b.argmaxed("SELECT count(*) FROM pos")})""",
    "capped_allocation": f"""WITH {b.POS} SELECT client, cnt::BIGINT AS cnt
        FROM ({b.capped(b.argmaxed("SELECT count(*) FROM pos"))})""",
    "non_iid_partition": f"""WITH {b.partitioned()} SELECT client, label, count(*) AS n,
        sum(l_orderkey)::BIGINT AS key_sum, sum(l_partkey)::BIGINT AS part_sum FROM shard GROUP BY ALL""",
    "holdout_and_shards": f"""WITH {b.partitioned()} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label, 'train' AS split, client
        FROM shard UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label, split, NULL FROM split WHERE split = 'holdout'""",
    "holdout_sample_row": f"""WITH {b.holdout()} SELECT l_quantity, l_extendedprice, l_discount, l_tax,
        CASE WHEN label = 1 THEN 'fraud' ELSE 'legitimate' END AS actual_class
      FROM split WHERE split = 'holdout' ORDER BY
        md5(concat_ws('|', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber)), l_orderkey LIMIT 1""",
    "synthetic_volume_target": f"""WITH {b.POS} SELECT client, count(*) AS n_pos,
        greatest(1, round_even(count(*) * 0.75::DOUBLE, 0))::BIGINT AS n_target FROM pos GROUP BY client""",
}
