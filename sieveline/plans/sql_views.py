"""CTEs that the oracles share: the testbed views and the fitted preprocessing in SQL."""

from __future__ import annotations

from sieveline.plans.testbed import FEATURES_A, INTERVALS_A, INTERVALS_C, SCORES_A

A_RAW = """
a_raw AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT)) AS row_id,
         CAST(l_orderkey AS VARCHAR) AS group_id,
         CASE l_returnflag WHEN 'R' THEN 'CONFIRMED' WHEN 'A' THEN 'FALSE POSITIVE'
                           WHEN 'N' THEN 'CANDIDATE' END AS raw_label,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

A = """
a AS (
  SELECT row_id, group_id, CASE raw_label WHEN 'CONFIRMED' THEN 1 ELSE 0 END AS label,
         quantity, price, discount, tax
  FROM a_raw WHERE raw_label IN ('CONFIRMED', 'FALSE POSITIVE', 'REFUTED'))"""

B_RAW = """
b_raw AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS group_id,
         CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'error' THEN 'FALSE POSITIVE'
                         WHEN 'signup' THEN 'REFUTED' WHEN 'view' THEN 'CANDIDATE'
                         ELSE event_type END AS raw_label,
         TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS amount,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN value > 0 THEN 1 ELSE 0 END AS default_flag
  FROM events)"""

B = """
b AS (
  SELECT event_id, group_id, CASE raw_label WHEN 'CONFIRMED' THEN 1 ELSE 0 END AS label,
         amount * 10000.0 AS amount, k
  FROM b_raw
  WHERE default_flag = 1 AND raw_label IN ('CONFIRMED', 'FALSE POSITIVE', 'REFUTED'))"""

C = """
c AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def screened(source: str, out: str, intervals: dict, keep: str) -> str:
    """`out`: the screened columns of `source`, out-of-range values NULL."""
    cols = []
    for name, (lo, hi) in intervals.items():
        tests = [f"{name} < {lo}"] * (lo is not None) + [f"{name} > {hi}"] * (hi is not None)
        cols.append(f"CASE WHEN {' OR '.join(tests)} THEN NULL ELSE {name} END AS {name}")
    return f"{out} AS (SELECT {keep}, {', '.join(cols)} FROM {source})"


A_SCREENED = screened("a", "s1", INTERVALS_A, "row_id, group_id, label")
C_SCREENED = screened("c", "c1", INTERVALS_C, "o_orderkey")

FOLDS = """
groups AS (
  SELECT group_id, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
  FROM a GROUP BY group_id),
folds AS (
  SELECT group_id, n_pos, n_neg,
         CAST((row_number() OVER (ORDER BY n_pos DESC, n_neg DESC, md5('42:' || group_id), group_id) - 1) % 5
              AS INTEGER) AS fold
  FROM groups)"""

HEAVY = """
groups AS (
  SELECT CASE WHEN CAST(split_part(row_id, '-', 3) AS INTEGER) % 5 = 0
              THEN 'big-' || (CAST(split_part(row_id, '-', 3) AS INTEGER) % 9) ELSE group_id END AS group_id,
         count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
  FROM a GROUP BY 1)"""

# heavy groups one by one to the fold they overfill least, then the order in which folds are dealt
HEAVY_FOLDS = """
tot AS (SELECT sum(n_pos) AS p, sum(n_neg) AS n, greatest(1.0, sum(n_pos) / 5.0) AS gp, greatest(1.0, sum(n_neg) / 5.0) AS gn FROM groups),
hv AS (
  SELECT group_id, n_pos, n_neg, row_number() OVER (ORDER BY n_pos + n_neg DESC, group_id) AS i
  FROM groups, tot WHERE n_pos + n_neg > (p + n) / 100.0),
placed AS (
  WITH RECURSIVE r(i, group_id, n_pos, n_neg, fold, lp, ln) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER),
           [0.0::DOUBLE, 0, 0, 0, 0], [0.0::DOUBLE, 0, 0, 0, 0]
    UNION ALL
    SELECT i, group_id, n_pos, n_neg, fold - 1,
           list_transform(lp, lambda x, k: x + CASE WHEN k = fold THEN n_pos ELSE 0 END),
           list_transform(ln, lambda x, k: x + CASE WHEN k = fold THEN n_neg ELSE 0 END)
    FROM (SELECT *, list_position(cost, list_min(cost)) AS fold FROM (
            SELECT hv.*, lp, ln,
                   list_transform([1, 2, 3, 4, 5], lambda f: greatest((lp[f] + hv.n_pos) / gp, (ln[f] + hv.n_neg) / gn)) AS cost
            FROM r JOIN hv ON hv.i = r.i + 1, tot)))
  SELECT * FROM r),
room AS (
  SELECT list_transform([1, 2, 3, 4, 5], lambda f: greatest(0.0, (p + n) / 5.0 - lp[f] - ln[f])) AS room
  FROM placed, tot ORDER BY i DESC LIMIT 1),
share AS (SELECT list_transform(room, lambda x: round(x / list_sum(room), 12)) AS share FROM room),
deal AS (
  WITH RECURSIVE d(j, pick, credit) AS (
    SELECT -1, CAST(NULL AS INTEGER), [0.0::DOUBLE, 0, 0, 0, 0]
    UNION ALL
    SELECT j + 1, pick, list_transform(c, lambda x, k: CASE WHEN k = pick THEN x - 1.0 ELSE x END)
    FROM (SELECT j, c, list_position(c, list_max(c)) AS pick FROM (
            SELECT j, list_transform([1, 2, 3, 4, 5], lambda f: credit[f] + share[f]) AS c FROM d, share WHERE j < 199)))
  SELECT j, pick - 1 AS pick FROM d WHERE j >= 0),
light AS (
  SELECT group_id, n_pos, n_neg,
         (row_number() OVER (ORDER BY n_pos DESC, n_neg DESC, md5('42:' || group_id), group_id) - 1) % 200 AS j
  FROM groups ANTI JOIN hv USING (group_id)),
folds AS (
  SELECT group_id, n_pos, n_neg, CAST(pick AS INTEGER) AS fold FROM light JOIN deal USING (j)
  UNION ALL SELECT group_id, n_pos, n_neg, fold FROM placed WHERE i > 0)"""

# the seven preprocessing steps, fitted on the rows outside fold 0
PREPARED = (
    FOLDS
    + """,
p0 AS (SELECT a.*, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split, fold FROM a JOIN folds USING (group_id)),
"""
    + screened("p0", "p1", INTERVALS_A, "row_id, group_id, label, split, fold")
    + """,
pm AS (SELECT max(discount) + 0.000001 AS top FROM p1 WHERE split = 'train'),
p2 AS (
  SELECT row_id, group_id, label, split, fold, quantity,
         CASE WHEN price < 0 THEN 0.0 ELSE ln(1 + price) END AS price,
         CASE WHEN top - discount < 0 THEN 0.0 ELSE ln(1 + (top - discount)) END AS discount, tax
  FROM p1, pm),
pq AS (SELECT """
    + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in FEATURES_A)
    + """ FROM p2 WHERE split = 'train'),
p3 AS (SELECT row_id, group_id, label, split, fold, """
    + ", ".join(
        f"CASE WHEN {c} < q_{c}[1] - 1.5 * (q_{c}[3] - q_{c}[1]) THEN q_{c}[1] - 1.5 * (q_{c}[3] - q_{c}[1])"
        f" WHEN {c} > q_{c}[3] + 1.5 * (q_{c}[3] - q_{c}[1]) THEN q_{c}[3] + 1.5 * (q_{c}[3] - q_{c}[1])"
        f" ELSE coalesce({c}, q_{c}[2]) END AS {c}"
        for c in FEATURES_A
    )
    + """ FROM p2, pq),
ps AS (SELECT """
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES_A)
    + """ FROM p3 WHERE split = 'train'),
p4 AS (SELECT row_id, group_id, label, split, fold, """
    + ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in FEATURES_A)
    + """ FROM p3, ps)"""
)


def score_sql(weights: dict) -> str:
    z = " + ".join([str(float(weights.get("", 0.0)))] + [f"({w}) * {c}" for c, w in weights.items() if c])
    return f"floor(1e6 / (1.0 + exp(-({z}))) + 0.5) / 1e6"


# (row_id, fold, dataset, model, score, label) for both stand-in models
SCORED = (
    FOLDS
    + """,
scored AS ("""
    + "\n  UNION ALL ".join(
        f"SELECT row_id, fold, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS dataset, '{m}' AS model, "
        f"{score_sql(w)} AS score, label FROM a JOIN folds USING (group_id)"
        for m, w in SCORES_A.items()
    )
    + ")"
)

F2_SQL = "CASE WHEN 5*tp + 4*fn + fp = 0 THEN 0.0 ELSE 5.0*tp / (5*tp + 4*fn + fp) END"
RECALL_SQL = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END"
PRECISION_SQL = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END"
COUNTS_SQL = """
       CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
       CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn,
       CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp"""


# the same steps with the candidates beside the labeled rows
PREPARED_ALL = PREPARED.replace(
    "fold FROM a JOIN folds USING (group_id)),",
    """fold FROM a JOIN folds USING (group_id)
       UNION ALL SELECT row_id, group_id, NULL, quantity, price, discount, tax, 'candidate', NULL FROM a_raw WHERE raw_label = 'CANDIDATE'),""",
    1,
)


def newton(c: float, steps: int = 12) -> str:
    """CTEs that fit the balanced logistic regression on the training rows of p4 by Newton steps; the
    last, `fitted`, holds w0.. and the intercept w4. A step's system is solved by Cholesky factors."""
    d = len(FEATURES_A) + 1
    x = [*FEATURES_A, "1.0"]
    out = [
        f"""nt AS MATERIALIZED (
  SELECT {', '.join(FEATURES_A)}, CAST(label AS DOUBLE) AS y, CASE label WHEN 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS s
  FROM p4, (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1 FROM p4 WHERE split = 'train') WHERE split = 'train')""",
        "w_0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(d)) + ")",
    ]
    z = " + ".join(f"w{i} * {v}" for i, v in enumerate(x))
    low = lambda i, j: f"l{i}{j}"
    for t in range(1, steps + 1):
        sums = [f"sum(r * {x[i]})" + (f" + any_value(w{i}) / {c}" if i < d - 1 else "") + f" AS g{i}" for i in range(d)]
        sums += [
            f"sum(h * {x[i]} * {x[j]})" + (f" + 1.0 / {c}" if i == j < d - 1 else "") + f" AS h{i}{j}"
            for i in range(d) for j in range(i + 1)
        ]
        solve = []  # each entry may name those before it, so each is a SELECT of its own
        for j in range(d):
            for i in range(j, d):
                rest = "".join(f" - {low(i, k)} * {low(j, k)}" for k in range(j))
                solve.append(f"sqrt(h{j}{j}{rest}) AS {low(j, j)}" if i == j else f"(h{i}{j}{rest}) / {low(j, j)} AS {low(i, j)}")
        for i in range(d):
            solve.append(f"(g{i}" + "".join(f" - {low(i, k)} * u{k}" for k in range(i)) + f") / {low(i, i)} AS u{i}")
        for i in reversed(range(d)):
            solve.append(f"(u{i}" + "".join(f" - {low(k, i)} * v{k}" for k in range(i + 1, d)) + f") / {low(i, i)} AS v{i}")
        olds = [f"any_value(w{i}) AS o{i}" for i in range(d)]
        z_rows = f"SELECT *, 1.0 / (1.0 + exp(-({z}))) AS p FROM nt, w_{t - 1}"
        step = f"SELECT {', '.join(sums + olds)} FROM (SELECT *, s * (p - y) AS r, s * p * (1.0 - p) AS h FROM ({z_rows}))"
        for one in solve:
            step = f"SELECT *, {one} FROM ({step})"
        news = ", ".join(f"o{i} - v{i} AS w{i}" for i in range(d))
        out.append(f"w_{t} AS MATERIALIZED (SELECT {news} FROM ({step}))")
    out.append(f"fitted AS (SELECT * FROM w_{steps})")
    return ",\n".join(out)


#: The margin of a row of p4 under `fitted`.
MARGIN = " + ".join([f"w{i} * {f}" for i, f in enumerate(FEATURES_A)] + [f"w{len(FEATURES_A)}"])
