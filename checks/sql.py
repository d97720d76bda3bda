"""Shared SQL fragments: the same stages as the Spark plans, written as plain CTEs."""

from __future__ import annotations

from retentio import schema
from retentio.sources.retail import PRODUCT_RULES

UNKNOWN = schema.UNKNOWN
OTHER = "Другое"
SEGMENT_NAMES = ["Отток", "Низколояльные", "Умеренно лояльные", "Лояльные", "Высоколояльные"]


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS BIGINT)"


def hash_key(seed: int, *ids: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def category_case(name: str = "product_name") -> str:
    parts = [f"WHEN {name} IS NULL THEN '{UNKNOWN}'"]
    for category, words in PRODUCT_RULES:
        hits = " OR ".join(f"contains(lower({name}), '{w}')" for w in words)
        parts.append(f"WHEN {hits} THEN '{category}'")
    return f"CASE {' '.join(parts)} ELSE '{OTHER}' END"


PRODUCT_CATEGORIES = [c for c, _ in PRODUCT_RULES] + [OTHER, UNKNOWN]

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(needs: list[str], final: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in CTES[name][0]:
            visit(n)
        ordered.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    return f"WITH {', '.join(parts)} {final}" if parts else final


cte(
    "lines",
    [],
    """SELECT o_custkey AS client_id, o_orderdate AS purchase_ts, l_orderkey AS order_key, l_linenumber AS line_number,
       l_partkey, l_suppkey, o_orderpriority,
       CASE WHEN l_quantity <> 50 THEN l_extendedprice END AS amount, CAST(l_quantity AS BIGINT) AS quantity,
       l_extendedprice * l_discount AS external_discount, l_extendedprice * l_tax AS bonus_earned,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount ELSE 0 END AS bonus_spent, l_extendedprice
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "purchases",
    ["lines"],
    """SELECT client_id, CASE WHEN c_acctbal >= -900 THEN c_mktsegment END AS gender,
       CASE WHEN n_regionkey <> 4 THEN n_name END AS card_store, purchase_ts,
       CASE WHEN quantity <> 1 THEN s_name END AS store, p_name AS product_name, amount, quantity, external_discount,
       bonus_earned, bonus_spent, c_acctbal + bonus_earned - bonus_spent AS balance_accrued,
       CASE WHEN p_type = 'PROMO' THEN l_extendedprice * CAST(0.01 AS DOUBLE) ELSE 0 END AS balance_gift,
       o_orderpriority, order_key, line_number, l_partkey AS part_key
       FROM lines JOIN customer ON client_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
)
cte(
    "facts",
    ["lines"],
    f"""SELECT client_id, min(purchase_ts) AS first_check_date, max(purchase_ts) AS last_check_date,
        CAST(count(DISTINCT purchase_ts) AS DOUBLE) AS purchase_days,
        count(*) / greatest(CAST(1 AS DOUBLE), {days('max(purchase_ts)', 'min(purchase_ts)')} / CAST(30 AS DOUBLE)) AS freq_per_month,
        avg(amount) AS avg_check FROM lines GROUP BY client_id""",
)
cte(
    "tx",
    ["purchases", "facts"],
    """SELECT p.* EXCLUDE (o_orderpriority), f.* EXCLUDE (client_id),
       CASE WHEN o_orderpriority <> '5-LOW' THEN first_check_date END AS card_date
       FROM purchases p JOIN facts f ON p.client_id = f.client_id""",
)
cte(
    "med",
    ["tx"],
    """SELECT client_id, quantile_cont(CAST(epoch_us(card_date) AS DOUBLE), 0.5) AS card_us,
       quantile_cont(amount, 0.5) AS amount_med FROM tx GROUP BY client_id""",
)
cte(
    "part_filled",
    ["tx", "med"],
    """SELECT tx.* REPLACE (coalesce(card_date, make_timestamp(CAST(floor(card_us) AS BIGINT))) AS card_date,
       coalesce(amount, amount_med) AS amount) FROM tx LEFT JOIN med ON tx.client_id = med.client_id""",
)
cte(
    "globals",
    ["part_filled"],
    """SELECT quantile_cont(CAST(epoch_us(card_date) AS DOUBLE), 0.5) AS g_card, quantile_cont(amount, 0.5) AS g_amount,
       avg(CAST(store IS NULL AS INT)) AS s_store, avg(CAST(card_store IS NULL AS INT)) AS s_card,
       (SELECT gender FROM part_filled WHERE gender IS NOT NULL GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1) AS m_gender,
       (SELECT store FROM part_filled WHERE store IS NOT NULL GROUP BY store ORDER BY count(*) DESC, store LIMIT 1) AS m_store,
       (SELECT card_store FROM part_filled WHERE card_store IS NOT NULL GROUP BY card_store ORDER BY count(*) DESC, card_store LIMIT 1) AS m_card
       FROM part_filled""",
)
cte(
    "filled",
    ["part_filled", "globals"],
    f"""SELECT p.* REPLACE (coalesce(card_date, make_timestamp(CAST(floor(g_card) AS BIGINT))) AS card_date,
        coalesce(amount, g_amount) AS amount, coalesce(gender, m_gender) AS gender,
        coalesce(store, CASE WHEN s_store < 0.05 THEN m_store ELSE '{UNKNOWN}' END) AS store,
        coalesce(card_store, CASE WHEN s_card < 0.05 THEN m_card ELSE '{UNKNOWN}' END) AS card_store)
        FROM part_filled p, globals""",
)
cte(
    "fences",
    ["filled"],
    "SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in schema.OUTLIER_COLUMNS
    )
    + " FROM filled",
)


def low(c: str) -> str:
    return f"(q1_{c} - 1.5 * (q3_{c} - q1_{c}))"


def high(c: str) -> str:
    return f"(q3_{c} + 1.5 * (q3_{c} - q1_{c}))"


cte(
    "cut",
    ["filled", "fences"],
    "SELECT f.* REPLACE ("
    + ", ".join(
        f"CASE WHEN {c} > {high(c)} THEN {high(c)} WHEN {low(c)} > 0 AND {c} < {low(c)} THEN {low(c)} ELSE {c} END AS {c}"
        for c in schema.OUTLIER_COLUMNS
    )
    + ") FROM filled f, fences",
)
cte(
    "ranges",
    ["cut"],
    "SELECT "
    + ", ".join([f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in schema.MONEY_COLUMNS])
    + ", "
    + ", ".join([f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in schema.RATE_COLUMNS])
    + " FROM cut",
)
cte(
    "scaled",
    ["cut", "ranges"],
    "SELECT c.* REPLACE ("
    + ", ".join(
        [f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in schema.MONEY_COLUMNS]
        + [f"CASE WHEN sd_{c} = 0 THEN 0 ELSE ({c} - mean_{c}) / sd_{c} END AS {c}" for c in schema.RATE_COLUMNS]
    )
    + ") FROM cut c, ranges",
)
cte(
    "top_stores",
    ["filled"],
    "SELECT store FROM filled GROUP BY store ORDER BY count(*) DESC, store LIMIT 10",
)
cte("genders", ["filled"], "SELECT gender, row_number() OVER (ORDER BY gender) - 1 AS gender_code FROM (SELECT DISTINCT gender FROM filled)")
cte(
    "enc",
    ["scaled", "genders", "top_stores"],
    f"""SELECT s.*, CAST(g.gender_code AS INT) AS gender_code, {category_case()} AS product_category,
        CASE WHEN t.store IS NULL THEN 'location_other' ELSE 'location_' || replace(replace(replace(replace(s.store, ' ', '_'), ',', ''), '.', ''), '/', '_') END AS location
        FROM scaled s JOIN genders g ON s.gender = g.gender LEFT JOIN top_stores t ON s.store = t.store""",
)
cte(
    "cust",
    ["enc"],
    f"""SELECT *, CAST(greatest(0, {days('now_ts', 'last_ts')}) AS BIGINT) AS recency,
        CAST(greatest(1, {days('last_ts', 'first_ts')}) AS BIGINT) AS activity_period,
        bonus_spent_sum / CASE WHEN bonus_earned_sum = 0 THEN 1 ELSE bonus_earned_sum END AS bonus_usage_ratio,
        frequency / greatest(1, {days('last_ts', 'first_ts')}) AS purchase_frequency
        FROM (SELECT client_id, count(amount) AS frequency, sum(amount) AS monetary, avg(amount) AS avg_purchase,
              stddev_samp(amount) AS amount_std, min(purchase_ts) AS first_ts, max(purchase_ts) AS last_ts,
              sum(bonus_earned) AS bonus_earned_sum, avg(bonus_earned) AS bonus_earned_mean,
              sum(bonus_spent) AS bonus_spent_sum, avg(bonus_spent) AS bonus_spent_mean,
              first(gender_code ORDER BY purchase_ts, gender_code) AS gender_code, first(product_category ORDER BY purchase_ts, list_position({PRODUCT_CATEGORIES}, product_category)) AS product_category
              FROM enc GROUP BY client_id), (SELECT max(purchase_ts) AS now_ts FROM enc)""",
)


def rfm_select(source: str, cuts: str) -> str:
    def fm(c):
        return f"CASE WHEN {c} <= {c}_1 THEN 1 WHEN {c} <= {c}_2 THEN 2 WHEN {c} <= {c}_3 THEN 3 ELSE 4 END"

    return f"""SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS rfm_group, R + F + M AS rfm_score,
        CASE WHEN R + F + M >= 9 THEN 'Высоколояльные' WHEN R + F + M >= 7 THEN 'Лояльные'
             WHEN R + F + M >= 5 THEN 'Умеренно лояльные' WHEN R + F + M >= 3 THEN 'Низколояльные' ELSE 'Отток' END AS loyalty_segment
        FROM (SELECT c.*, CASE WHEN recency <= recency_1 THEN 4 WHEN recency <= recency_2 THEN 3 WHEN recency <= recency_3 THEN 2 ELSE 1 END AS R,
              {fm('frequency')} AS F, {fm('monetary')} AS M FROM {source} c, {cuts})"""


def cuts_select(source: str) -> str:
    return (
        "SELECT "
        + ", ".join(
            f"quantile_cont({m}, {p}) AS {m}_{i}"
            for m in ("recency", "frequency", "monetary")
            for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))
        )
        + f" FROM {source}"
    )


cte(
    "plain",
    ["lines"],
    f"""SELECT client_id, count(amount) AS frequency, sum(amount) AS monetary, avg(amount) AS avg_purchase, {days('any_value(now_ts)', 'max(purchase_ts)')} AS recency
        FROM lines, (SELECT max(purchase_ts) AS now_ts FROM lines) GROUP BY client_id""",
)
cte("plain_cuts", ["plain"], cuts_select("plain"))
cte("overview", ["plain", "plain_cuts"], rfm_select("plain", "plain_cuts"))
cte("cuts", ["cust"], cuts_select("cust"))
cte("rfm1", ["cust", "cuts"], rfm_select("cust", "cuts"))
cte("survivors", ["rfm1"], "SELECT * EXCLUDE (R, F, M, rfm_group, rfm_score, loyalty_segment) FROM rfm1 WHERE amount_std IS NOT NULL")
cte("cuts2", ["survivors"], cuts_select("survivors"))
cte("rfm", ["survivors", "cuts2"], rfm_select("survivors", "cuts2"))


def nz(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 1 ELSE {c} END"


cte(
    "feat",
    ["rfm"],
    f"""SELECT *, 1 - least(greatest(amount_cv, 0), 1) AS purchase_stability
        FROM (SELECT *, bonus_earned_sum / ({nz('monetary')}) AS bonus_earning_ratio, (bonus_spent_sum + bonus_earned_sum) / 2 AS bonus_activity,
              recency / activity_period AS recency_ratio, frequency / activity_period AS purchase_density,
              amount_std / ({nz('avg_purchase')}) AS amount_cv, R * CAST(0.5 AS DOUBLE) + F * CAST(0.3 AS DOUBLE) + M * CAST(0.2 AS DOUBLE) AS weighted_rfm
              FROM rfm)""",
)
cte(
    "location_shares",
    ["enc"],
    """SELECT client_id, location, k / CAST(n AS DOUBLE) AS share FROM (SELECT client_id, location, count(*) AS k FROM enc GROUP BY 1, 2)
       JOIN (SELECT client_id, count(*) AS n FROM enc GROUP BY 1) USING (client_id)""",
)
cte(
    "product_shares",
    ["enc"],
    """SELECT client_id, product_category AS category, k, n, k / CAST(n AS DOUBLE) AS share FROM
       (SELECT client_id, product_category, count(*) AS k FROM enc GROUP BY 1, 2)
       JOIN (SELECT client_id, count(*) AS n FROM enc GROUP BY 1) USING (client_id)""",
)
cte(
    "diversity",
    ["location_shares", "product_shares"],
    """SELECT * FROM (SELECT client_id, sum(share) AS product_diversity, CAST(count(*) AS INT) AS product_categories,
       CAST(any_value(n) * any_value(n) - sum(k * k) AS DOUBLE) / CAST(any_value(n) * any_value(n) AS DOUBLE) AS product_gini FROM product_shares GROUP BY client_id)
       JOIN (SELECT client_id, max(share) AS location_loyalty, CAST(count(*) AS INT) AS location_diversity FROM location_shares GROUP BY client_id) USING (client_id)""",
)


def score(base: str, extra: str = "") -> str:
    return f"""least(greatest(CAST(0.7 AS DOUBLE) * {base} + CAST(0.15 AS DOUBLE) * least(greatest(bonus_usage_ratio, 0), 1){extra}
        + CAST(0.15 AS DOUBLE) * purchase_stability - CAST(0.2 AS DOUBLE) * least(greatest(recency_ratio, 0), 1), 0), 1)"""


def categories_case(s: str, b: list[str]) -> str:
    parts = [f"WHEN {s} >= {b[i]} AND {s} < {b[i + 1]} THEN '{SEGMENT_NAMES[i]}'" for i in range(5)]
    return f"CASE {' '.join(parts)} ELSE '{SEGMENT_NAMES[4]}' END"


for mode, base in (("raw", "weighted_rfm"), ("unit", "((weighted_rfm - 1) / 3)")):
    cte(f"scored_{mode}", ["feat"], f"SELECT *, {score(base)} AS loyalty_score FROM feat")
    cte(
        f"bounds_{mode}",
        [f"scored_{mode}"],
        "SELECT " + ", ".join(f"quantile_cont(loyalty_score, {p}) AS b{i}" for i, p in enumerate((0.2, 0.4, 0.6, 0.8), 1)) + f" FROM scored_{mode}",
    )
    cte(
        f"cat_{mode}",
        [f"scored_{mode}", f"bounds_{mode}"],
        f"SELECT s.*, {categories_case('loyalty_score', ['0', 'b1', 'b2', 'b3', 'b4', '1'])} AS loyalty_category FROM scored_{mode} s, bounds_{mode}",
    )
cte("target_raw", ["cat_raw"], "SELECT *, CASE loyalty_category WHEN 'Отток' THEN 0 WHEN 'Высоколояльные' THEN 1 END AS loyalty_target FROM cat_raw")
FIVE_CASE = "CASE {c} WHEN 'Отток' THEN 0 WHEN 'Низколояльные' THEN 0 WHEN 'Умеренно лояльные' THEN 1 WHEN 'Лояльные' THEN 2 WHEN 'Высоколояльные' THEN 3 END"
cte("target_unit", ["cat_unit"], f"SELECT *, {FIVE_CASE.format(c='loyalty_category')} AS loyalty_target FROM cat_unit")
cte(
    "guess",
    ["target_unit"],
    f"SELECT client_id, loyalty_target AS label, {FIVE_CASE.format(c='loyalty_segment')} AS prediction, rfm_score FROM target_unit",
)
cte(
    "class_rows",
    ["guess"],
    """SELECT class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits,
       CASE WHEN sum(predicted) > 0 THEN sum(hits) / CAST(sum(predicted) AS DOUBLE) ELSE 0 END AS prec,
       CASE WHEN sum(support) > 0 THEN sum(hits) / CAST(sum(support) AS DOUBLE) ELSE 0 END AS rec FROM
       (SELECT label AS class, 1 AS support, 0 AS predicted, CAST(label = prediction AS INT) AS hits FROM guess
        UNION ALL SELECT prediction, 0, 1, 0 FROM guess) GROUP BY class""",
)
cte("class_f1", ["class_rows"], "SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM class_rows")
