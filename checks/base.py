"""SQL of the views the registered queries share."""

TXN = """txn AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
         CASE l_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS client,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 1 ELSE 0 END AS label
  FROM lineitem)"""
POS = TXN + """, pos AS (SELECT * FROM txn WHERE label = 1)"""
LONG_POS = POS + """, long AS (
  SELECT client, 'l_quantity' AS "column", 1 AS ci, l_quantity AS value FROM pos UNION ALL
  SELECT client, 'l_extendedprice', 2, l_extendedprice FROM pos UNION ALL
  SELECT client, 'l_discount', 3, l_discount FROM pos UNION ALL
  SELECT client, 'l_tax', 4, l_tax FROM pos)"""
CAND = POS + """, cand AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client, 'augment_ctgan' AS mode, l_quantity,
         round(l_extendedprice * 1.03, 4) AS l_extendedprice, round(l_discount + 0.004, 4) AS l_discount,
         l_tax, 1 AS label FROM pos WHERE client = 'A'
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client, 'schema_llm', l_quantity,
         ceil(l_extendedprice / 20000.0) * 20000.0, round(l_discount + 0.004, 4), l_tax, 1
  FROM pos WHERE client = 'A'
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client, 'augment_ctgan',
         CASE WHEN l_tax = 0.0 THEN NULL ELSE l_quantity END,
         CASE WHEN l_tax = 0.01 THEN 'inf'::DOUBLE WHEN l_tax = 0.03 THEN 'nan'::DOUBLE
              WHEN l_tax >= 0.04 THEN l_extendedprice * -100.0 ELSE l_extendedprice END,
         l_discount, l_tax, CASE WHEN l_tax = 0.02 THEN 0 ELSE 1 END FROM pos WHERE client = 'B'
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client, 'schema_llm', 100.0,
         round(l_extendedprice * 3 + 105000, 4), 0.3, 0.25, 1 FROM pos WHERE client = 'C'
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client, 'schema_llm', l_quantity,
         l_extendedprice, l_discount, l_tax, 1 FROM pos WHERE client = 'D')"""


def ranked(source: str, strata: str, seed: int, out: str = "rank") -> str:
    """Seeded rank of a source that carries the transaction key."""
    return (f"SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY "
            f"md5(concat_ws('|', '{seed}', l_orderkey, l_partkey, l_suppkey, l_linenumber)), "
            f"l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS {out} "
            f"FROM {source}")


def holdout(test_size: float = 0.2, seed: int = 42) -> str:
    """CTEs up to ``split``: txn with a split column in {train, holdout}."""
    return TXN + f""", ranked AS ({ranked('txn', 'label', seed)}),
  cnt AS (SELECT label, count(*) AS n FROM txn GROUP BY label),
  exact AS (SELECT label, n, ceil({test_size}::DOUBLE * sum(n) OVER ()) AS n_test,
                   n * ceil({test_size}::DOUBLE * sum(n) OVER ()) / sum(n) OVER () AS e FROM cnt),
  quota AS (SELECT label, floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, label)
                   <= n_test - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM exact),
  split AS (SELECT r.* EXCLUDE (rank), CASE WHEN rank <= quota THEN 'holdout' ELSE 'train' END AS split
            FROM ranked r JOIN quota USING (label))"""


SHARES = "(VALUES (0,'A',0.45,true),(1,'B',0.25,true),(2,'C',0.2,false),(3,'D',0.1,false)) s(pos,client,share,rich)"
SHARE_VALUES = {"A": 0.45, "B": 0.25, "C": 0.2, "D": 0.1}
WEIGHTS = "(VALUES (0,'A',0.35,true),(1,'B',0.35,true),(2,'C',0.15,false),(3,'D',0.15,false)) w(pos,client,share,rich)"


def weighted(total: str) -> str:
    return f"""SELECT pos, client, cnt + CASE WHEN pos = 3 THEN total - sum(cnt) OVER () ELSE 0 END AS cnt
      FROM (SELECT pos, client, round_even(share::DOUBLE * ({total}), 0)::BIGINT AS cnt, ({total}) AS total
            FROM {WEIGHTS})"""


def argmaxed(total: str) -> str:
    return f"""SELECT pos, client, share, rich,
             cnt + CASE WHEN row_number() OVER (ORDER BY share DESC, pos) = 1
                        THEN total - sum(cnt) OVER () ELSE 0 END AS cnt
      FROM (SELECT *, round_even(share::DOUBLE * ({total}), 0)::BIGINT AS cnt, ({total}) AS total FROM {SHARES})"""


def capped(source: str, cap: int = 15) -> str:
    return f"""SELECT pos, client, c1 + CASE WHEN pos = first_rich AND excess > 0
                                   THEN total - sum(c1) OVER () ELSE 0 END AS cnt
      FROM (SELECT pos, client, excess, total, first_rich,
                   CASE WHEN NOT rich THEN least(cnt, {cap})
                        ELSE cnt + round_even(share::DOUBLE / rich_share * excess, 0)::BIGINT END AS c1
            FROM (SELECT *, sum(cnt) OVER () AS total, min(CASE WHEN rich THEN pos END) OVER () AS first_rich,
                         sum(CASE WHEN rich THEN share::DOUBLE ELSE 0 END) OVER () AS rich_share,
                         sum(CASE WHEN NOT rich AND cnt > {cap} THEN cnt - {cap} ELSE 0 END) OVER () AS excess
                  FROM ({source})))"""


def partitioned(seed: int = 42, cap: int = 15) -> str:
    """CTEs up to ``shard``: the train pool with its assigned client."""
    return holdout(0.2, seed) + f""",
  pool AS (SELECT * EXCLUDE (client) FROM split WHERE split = 'train'),
  prank AS ({ranked('pool', 'label', seed)}),
  negc AS ({weighted("SELECT count(*) FROM pool WHERE label = 0")}),
  posc AS ({capped(argmaxed("SELECT count(*) FROM pool WHERE label = 1"), cap)}),
  rng AS (SELECT 0 AS label, client, sum(cnt) OVER (ORDER BY pos) - cnt AS lo,
                 sum(cnt) OVER (ORDER BY pos) AS hi FROM negc
          UNION ALL
          SELECT 1, client, sum(cnt) OVER (ORDER BY pos) - cnt, sum(cnt) OVER (ORDER BY pos) FROM posc),
  shard AS (SELECT p.* EXCLUDE (rank), r.client FROM prank p JOIN rng r
            ON p.label = r.label AND p.rank > r.lo AND p.rank <= r.hi)"""
