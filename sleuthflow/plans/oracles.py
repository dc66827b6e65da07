"""DuckDB check of each registered query, written from the operator definitions."""

from __future__ import annotations

from sleuthflow import catalog
from sleuthflow.operators.findings import CONCLUSIONS, WORDING
from sleuthflow.plans.views import BORDERLINE_STRIP, WINDOW_HOURS

D = "DOUBLE"


def _clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, CAST({low!r} AS {D})), CAST({high!r} AS {D}))"


def _d(x: float | str) -> str:
    return f"CAST({x} AS {D})"


def _sigmoid(x: str) -> str:
    return f"1.0::{D} / (1.0::{D} + exp(-({x})))"


def _reason(bounds: dict[str, tuple[float, float]], noun: str) -> str:
    whens = "".join(
        f"WHEN {name} IS NULL OR NOT ({name} BETWEEN {_d(low)} AND {_d(high)}) "
        f"THEN '{noun} ''{name}'' out of range [{low}, {high}]: ' || CAST({name} AS DOUBLE) "
        for name, (low, high) in bounds.items()
    )
    return whens


def _population_map(rounds: int = 600) -> str:
    """Two principal components by power iteration on the correlation matrix, the second after deflation."""
    n, names = len(catalog.FEATURES), catalog.FEATURES

    def known(value: str) -> str:
        return f"coalesce(CASE WHEN isfinite({value}) THEN {value} END, 0)"

    matrix = ", ".join("[" + ", ".join(known(f"corr({a}, {b})") for b in names) + "]" for a in names)
    scores = ", ".join(known(f"(({a} - s.stat['{a}_mean']) / nullif(s.stat['{a}_dev'], 0))") for a in names)
    stats = ", ".join(f"'{a}_mean': avg({a}), '{a}_dev': stddev_pop({a})" for a in names)

    def power(name: str, source: str) -> str:
        start = ", ".join(f"{1 + k / 10}::DOUBLE" for k in range(n))
        return f"""{name}_run(i, v) AS (SELECT 0, [{start}] UNION ALL
            SELECT i + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
            FROM (SELECT i, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {name}_run, {source} WHERE i < {rounds})),
        {name} AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)),
            list_max(list_transform(v, lambda y: abs(y))))])) AS v FROM {name}_run WHERE i = {rounds})"""

    return f"""WITH RECURSIVE s AS (SELECT {{{stats}}} AS stat FROM lab), c AS (SELECT [{matrix}] AS m FROM lab),
        {power("first", "c")},
        flat AS (SELECT list_transform(range(1, {n + 1}), lambda a: list_transform(range(1, {n + 1}), lambda b: m[a][b]
            - list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) * v[a] * v[b])) AS m FROM c, first),
        {power("second", "flat")}
        SELECT entity_id, label, is_borderline, list_dot_product([{scores}], first.v) AS pca1,
            list_dot_product([{scores}], second.v) AS pca2 FROM lab, s, first, second"""


def _display(metric: str) -> str:
    """Text of a metric: money with separators, counts without, shares in percent."""
    if metric in ("total_inflow", "total_outflow", "crypto_inflow", "crypto_outflow", "total_volume"):
        return f"format('{{:,.0f}}', {metric})"
    if metric == "dependency_ratio" or metric == "concentration_index":
        return f"printf('%.3f', {metric})"
    if metric == "avg_holding_time":
        return f"printf('%.1f', {metric})"
    if metric == "entropy_of_flows":
        return f"printf('%.4f', {metric})"
    if metric.endswith("_ratio"):
        return f"printf('%.1f%%', {metric} * 100)"
    return f"printf('%.0f', {metric}::DOUBLE)"


def _narrative() -> str:
    """Text of the findings: risk level, a sentence per finding, the conclusion."""
    rising = {
        "physical": ("physical_inflow_ratio * 100", 60, 35),
        "crypto": ("crypto_exposure_ratio * 100", 30, 10),
        "dependency": ("dependency_ratio", 0.8, 0.5),
        "concentration": ("concentration_index * 100", 40, 25),
    }
    lines = []
    for name in ("physical", "crypto", "dependency", "holding", "concentration"):
        pattern, red, yellow, green = WORDING[name]
        value, high, low = rising.get(name, ("avg_holding_time", 30, 60))
        sign = "<" if name == "holding" else ">="
        tail = f"CASE WHEN {value} {sign} {high} THEN '{red}' WHEN {value} {sign} {low} THEN '{yellow}' ELSE '{green}' END"
        lines.append(f"printf('{pattern}', {value}) || {tail}")
    closing = "CASE " + " ".join(
        f"WHEN probability >= {limit} THEN '{CONCLUSIONS[key]}'"
        for limit, key in ((0.75, "priority_check"), (0.55, "deep_analysis"), (0.30, "monitoring"))
    )
    head = "'Risk level ' || risk_level || printf(' (%.1f%%)', probability * 100)"
    last = f"'Company ' || company_id || ': ' || {closing} ELSE '{CONCLUSIONS['no_action']}' END"
    return "concat_ws(chr(10) || chr(10), " + ", ".join([head, *lines, last]) + ")"


_OPS_REASON = (
    "CASE " + _reason(catalog.OPERATIONAL_BOUNDS, "Operational field")
    + "WHEN referred_clients_current > new_clients_current "
    "THEN 'referred_clients_current cannot exceed new_clients_current.' "
    "WHEN top1_wallet_share > top10_wallet_share "
    "THEN 'top1_wallet_share cannot exceed top10_wallet_share.' END"
)

_RAW_FEATURES = {
    "growth_rate": "(new_clients_current - new_clients_previous) / greatest(new_clients_previous, 1)",
    "referral_ratio": "referred_clients_current / greatest(new_clients_current, 1)",
    "payout_dependency": "payouts_total / greatest(incoming_funds, 1)",
    "centralization_index": "top1_wallet_share",
    "avg_holding_time": "avg_holding_days",
    "reinvestment_rate": "repeat_investor_share",
    "gini_coefficient": f"{_d(0.12)} + {_d(0.72)} * top10_wallet_share + {_d(0.22)} * top1_wallet_share",
    "transaction_entropy": f"{_d(0.3)} + {_d(4.7)} * (ln(1 + unique_counterparties) "
    f"/ ln(1 + greatest(tx_count_total, unique_counterparties + 1))) * (1 - {_d(0.55)} * top1_wallet_share)",
    "structural_depth": "max_referral_depth",
}


def _features(source: str, keep: str) -> str:
    columns = ", ".join(f"{_clip(_RAW_FEATURES[n], *catalog.FEATURE_BOUNDS[n])} AS {n}" for n in catalog.FEATURES)
    return f"SELECT {keep}, {columns} FROM {source}"


_PROXY = _clip(
    f"growth_rate * {_d(0.35)} + payout_dependency * {_d(0.35)} + centralization_index * {_d(0.30)}", 0.0, 1.0
)


def _client_facts(n: str) -> str:
    return (
        f"{_d(n)} AS new_clients_current, greatest(1, floor({_d(n)} * {_d(0.8)})) AS new_clients_previous, "
        f"floor({_d(n)} * {_d(0.3)}) AS referred_clients_current, {_d(30)} AS avg_holding_days, "
        f"{_d(0.2)} AS repeat_investor_share, {_d(3)} AS max_referral_depth"
    )


def _walk_levels(depth: int) -> list[tuple[str, list[str], str]]:
    blocks = [("front1", ["edge"], "SELECT DISTINCT case_id, dst AS v FROM edge")]
    for k in range(2, depth + 1):
        blocks.append(
            (
                f"front{k}",
                [f"front{k - 1}"],
                f"SELECT DISTINCT e.case_id, e.dst AS v FROM edge e JOIN front{k - 1} f ON e.case_id = f.case_id AND e.src = f.v",
            )
        )
    return blocks


_OPS = ", ".join(catalog.OPERATIONAL)
_NORM = {
    name: _clip(f"({name} - {_d(low)}) / {_d(high - low)}", 0.0, 1.0)
    for name, (low, high) in catalog.COMPANY_NORM_BOUNDS.items()
}
_FACTORS = {
    "dependency_ratio": _NORM["dependency_ratio"],
    "crypto_exposure_ratio": _NORM["crypto_exposure_ratio"],
    "concentration_index": _NORM["concentration_index"],
    "inverse_holding_time": f"1.0::{D} - {_NORM['avg_holding_time']}",
    "inverse_entropy": f"1.0::{D} - {_NORM['entropy_of_flows']}",
}

# name, blocks it needs, body
_BLOCKS: list[tuple[str, list[str], str]] = [
    (
        "tx",
        [],
        """SELECT CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS sender_id,
        CASE WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS receiver_id,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    (
        "inflow",
        ["tx"],
        """SELECT e, CAST(sum(v) AS DOUBLE) AS incoming, CAST(max(v) AS DOUBLE) AS top1,
        CAST(sum(v) FILTER (rn <= 10) AS DOUBLE) AS top10, count(*) AS senders
        FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY v DESC, s) AS rn
              FROM (SELECT receiver_id AS e, sender_id AS s, sum(amount) AS v FROM tx GROUP BY ALL)) GROUP BY e""",
    ),
    (
        "touch",
        ["tx"],
        """SELECT e, count(*) AS n_tx FROM (SELECT receiver_id AS e FROM tx
        UNION ALL SELECT sender_id FROM tx WHERE sender_id <> receiver_id) GROUP BY e""",
    ),
    (
        "circle",
        ["tx"],
        """SELECT e, count(DISTINCT p) AS n FROM (SELECT receiver_id AS e, sender_id AS p FROM tx
        UNION ALL SELECT sender_id, receiver_id FROM tx UNION ALL SELECT sender_id, sender_id FROM tx
        UNION ALL SELECT receiver_id, receiver_id FROM tx) GROUP BY e""",
    ),
    ("outflow", ["tx"], "SELECT sender_id AS e, CAST(sum(amount) AS DOUBLE) AS paid FROM tx GROUP BY 1"),
    (
        "ops_all",
        ["inflow", "touch", "circle", "outflow"],
        f"""SELECT t.e AS entity_id, {_d('n_tx')} AS tx_count_total, {_d('c.n')} AS unique_counterparties,
        {_client_facts('coalesce(senders, 10)')}, coalesce(incoming, 0) AS incoming_funds,
        coalesce(paid, 0) AS payouts_total,
        CASE WHEN incoming > 0 THEN top1 / incoming ELSE 0 END AS top1_wallet_share,
        CASE WHEN incoming > 0 THEN top10 / incoming ELSE 0 END AS top10_wallet_share
        FROM touch t JOIN circle c USING (e) LEFT JOIN inflow USING (e) LEFT JOIN outflow USING (e)""",
    ),
    ("ops_checked", ["ops_all"], f"SELECT *, {_OPS_REASON} AS reason FROM ops_all"),
    ("ops", ["ops_checked"], "SELECT * FROM ops_checked WHERE reason IS NULL"),
    ("feat", ["ops"], _features("ops", "entity_id")),
    (
        "planted",
        ["feat"],
        f"""SELECT *, CAST(round({_PROXY} + {_d(0.3)}
        * CAST(('0x' || substr(md5(entity_id), 1, 6)) AS INTEGER) / {_d(16777216)}, 6) AS DECIMAL(12,6)) AS planted FROM feat""",
    ),
    (
        "lab",
        ["planted"],
        f"""SELECT * EXCLUDE (planted, gap), CAST(gap >= 0 AS INTEGER) AS label,
        abs(gap) <= {_d(BORDERLINE_STRIP)} AS is_borderline
        FROM (SELECT *, CAST(planted AS DOUBLE) - round(
              (SELECT CAST(sum(planted) AS DOUBLE) / count(*) FROM planted), 7) AS gap FROM planted)""",
    ),
    (
        "overlap",
        ["lab"],
        "SELECT feature, low0, high0, low1, high1, CASE WHEN greatest(high0, high1) = least(low0, low1) THEN 0.0::DOUBLE "
        "ELSE greatest(0, least(high0, high1) - greatest(low0, low1)) "
        "/ (greatest(high0, high1) - least(low0, low1)) END AS overlap_ratio FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS feature, " + ", ".join(
                f"quantile_cont({n}, {p}) FILTER (label = {c}) AS {side}{c}"
                for c in (0, 1)
                for side, p in (("low", 0.05), ("high", 0.95))
            ) + " FROM lab"
            for n in catalog.FEATURES
        )
        + ")",
    ),
    (
        "split",
        ["lab"],
        """SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(entity_id), entity_id)
        <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM lab""",
    ),
    ("pca", ["lab"], _population_map()),
    (
        "score",
        ["lab"],
        f"""SELECT s, sum(label) AS tp, sum(1 - label) AS fp FROM
        (SELECT label, round({_PROXY}, 4) AS s FROM lab) GROUP BY s""",
    ),
    (
        "ranked",
        ["score"],
        """SELECT *, sum(tp) OVER w AS tps, sum(fp) OVER w AS fps, lead(tp) OVER w AS ntp, lead(fp) OVER w AS nfp,
        row_number() OVER w AS rn, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM score
        WINDOW w AS (ORDER BY s DESC)""",
    ),
    (
        "led",
        [],
        """SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS d, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
        CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_suppkey % 3 = 0) THEN 'out' ELSE 'in' END AS dir,
        CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN 'physical' WHEN c_mktsegment = 'MACHINERY' THEN 'exchange'
        ELSE 'legal' END AS kind, n_name AS name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    ),
    (
        "flow",
        ["led"],
        """SELECT company_id, d, coalesce(sum(amount) FILTER (dir = 'in'), 0) AS i,
        coalesce(sum(amount) FILTER (dir = 'out'), 0) AS o, sum(amount) AS v,
        row_number() OVER (PARTITION BY company_id ORDER BY d) AS k FROM led GROUP BY company_id, d""",
    ),
    (
        "spans",
        ["flow"],
        """SELECT *, sum(i) OVER w AS i_end, sum(o) OVER w AS o_sum, sum(i) OVER w - i AS i_begin,
        sum(i - o) OVER w AS bal FROM flow WINDOW w AS (PARTITION BY company_id ORDER BY d)""",
    ),
    (
        "paid",
        ["spans"],
        # Outflow that finds no money in hand is lost: it shifts later payments back on the inflow axis.
        """SELECT *, o_sum + lost AS paid_end FROM (SELECT *, least(0, min(bal) OVER (PARTITION BY company_id ORDER BY d)) AS lost
        FROM spans)""",
    ),
    (
        "paid2",
        ["paid"],
        "SELECT *, coalesce(lag(paid_end) OVER (PARTITION BY company_id ORDER BY d), 0) AS paid_begin FROM paid",
    ),
    (
        "hold",
        ["paid2"],
        """SELECT company_id, CAST(coalesce(round(greatest(1, sum(CAST(least(i_end, paid_end) - greatest(i_begin, paid_begin) AS DOUBLE)
        * greatest(1, ok - ik)) / sum(CAST(least(i_end, paid_end) - greatest(i_begin, paid_begin) AS DOUBLE))), 1), 90) AS DOUBLE)
        AS avg_holding_time FROM (SELECT DISTINCT company_id FROM flow) LEFT JOIN
        (SELECT a.company_id, a.i_begin, a.i_end, a.k AS ik, b.paid_begin, b.paid_end, b.k AS ok FROM paid2 a JOIN paid2 b
         ON a.company_id = b.company_id AND a.i_begin < b.paid_end AND b.paid_begin < a.i_end
         WHERE a.i > 0 AND b.paid_end > b.paid_begin) USING (company_id) GROUP BY company_id""",
    ),
    (
        "conc",
        ["led"],
        """SELECT company_id, CAST(sum(v) FILTER (rn <= 5) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS concentration_index FROM
        (SELECT company_id, name, sum(amount) AS v, row_number() OVER (PARTITION BY company_id ORDER BY sum(amount) DESC, name) AS rn
         FROM led GROUP BY company_id, name) GROUP BY company_id""",
    ),
    (
        "entr",
        ["flow"],
        """SELECT company_id, round(-sum(p * log2(p)) / log2(greatest(count(*), 2)), 4) AS entropy_of_flows FROM
        (SELECT company_id, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY company_id) AS DOUBLE) AS p FROM flow)
        WHERE p > 0 GROUP BY company_id""",
    ),
    (
        "core",
        ["led"],
        """SELECT company_id, ti AS total_inflow, t_o AS total_outflow, ci AS crypto_inflow, co AS crypto_outflow,
        pi_ / greatest(ti, 1) AS physical_inflow_ratio, (ci + co) / greatest(ti + t_o, 1) AS crypto_exposure_ratio,
        t_o / greatest(ti, 1) AS dependency_ratio, li / greatest(ti, 1) AS legal_inflow_ratio,
        ci / greatest(ti, 1) AS exchange_inflow_ratio, total_transactions, inflow_count, outflow_count,
        unique_counterparties, ti + t_o AS total_volume FROM (SELECT company_id,
        CAST(coalesce(sum(amount) FILTER (dir = 'in'), 0) AS DOUBLE) AS ti,
        CAST(coalesce(sum(amount) FILTER (dir = 'out'), 0) AS DOUBLE) AS t_o,
        CAST(coalesce(sum(amount) FILTER (dir = 'in' AND kind = 'exchange'), 0) AS DOUBLE) AS ci,
        CAST(coalesce(sum(amount) FILTER (dir = 'out' AND kind = 'exchange'), 0) AS DOUBLE) AS co,
        CAST(coalesce(sum(amount) FILTER (dir = 'in' AND kind = 'physical'), 0) AS DOUBLE) AS pi_,
        CAST(coalesce(sum(amount) FILTER (dir = 'in' AND kind = 'legal'), 0) AS DOUBLE) AS li,
        CAST(count(*) AS DOUBLE) AS total_transactions, CAST(count(*) FILTER (dir = 'in') AS DOUBLE) AS inflow_count,
        CAST(count(*) FILTER (dir = 'out') AS DOUBLE) AS outflow_count,
        CAST(count(DISTINCT name) AS DOUBLE) AS unique_counterparties FROM led GROUP BY company_id)""",
    ),
    (
        "met",
        ["core", "hold", "conc", "entr"],
        "SELECT * FROM core JOIN hold USING (company_id) JOIN conc USING (company_id) JOIN entr USING (company_id)",
    ),
    (
        "crisk",
        ["met"],
        "SELECT *, CASE WHEN raw >= 0.70 THEN 'Critical' WHEN raw >= 0.50 THEN 'High' WHEN raw >= 0.30 THEN 'Medium' ELSE 'Low' END "
        "AS risk_level, round(raw, 4) AS probability FROM (SELECT *, "
        + " + ".join(f"contribution_{n}" for n in _FACTORS)
        + " AS raw FROM (SELECT *, "
        + ", ".join(f"{_d(catalog.COMPANY_WEIGHTS[n])} * ({x}) AS contribution_{n}" for n, x in _FACTORS.items())
        + ", "
        + ", ".join(f"round({x}, 4) AS normalized_{n}" for n, x in _FACTORS.items())
        + " FROM met))",
    ),
    (
        "ev_raw",
        [],
        """SELECT event_id AS pos, CAST(event_id AS VARCHAR) AS event_id, ts, CAST(value AS DECIMAL(18,2)) AS amount,
        'U' || user_id AS sender_id, 'U' || (5 * (user_id // 5) + CAST(json_extract(props, '$.k') AS BIGINT) % 8) AS receiver_id,
        CASE WHEN event_type IN ('purchase', 'click') THEN 'company' ELSE 'wallet' END AS sender_type,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'crypto' ELSE 'legal' END AS channel,
        'c' || (user_id // 5) || '-' || strftime(ts, '%Y%m%d') AS case_id, event_type FROM events""",
    ),
    ("ev", ["ev_raw"], "SELECT * FROM ev_raw WHERE sender_id <> receiver_id"),
    (
        "w",
        ["ev"],
        f"""SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY case_id) AS end_ts FROM ev)
        WHERE ts >= end_ts - INTERVAL {WINDOW_HOURS} HOUR""",
    ),
    (
        "edge",
        ["w"],
        "SELECT case_id, sender_id AS src, receiver_id AS dst, sum(amount) AS amount FROM w GROUP BY ALL",
    ),
    (
        "gaps",
        ["w"],
        """SELECT case_id, count(*) AS n_events, count(*) FILTER (us - prev <= 90000000) AS short_gaps,
        count(*) FILTER (us - prev <= 90000000) / greatest(count(*) - 1, 1)::DOUBLE AS gap_density,
        (max(us) - min(us)) / 60e6::DOUBLE / greatest(count(*) - 1, 1) AS avg_delta_minutes,
        greatest((max(us) - min(us)) / 3600e6::DOUBLE, 1) AS span_hours FROM
        (SELECT case_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS prev FROM w)
        GROUP BY case_id""",
    ),
    (
        "tot",
        ["w"],
        """SELECT case_id, count(*) AS events, CAST(sum(amount) AS DOUBLE) AS total,
        CAST(coalesce(sum(amount) FILTER (sender_type IN ('company', 'legal_entity', 'merchant')), 0) AS DOUBLE) AS paid,
        count(*) FILTER (channel = 'crypto') AS crypto, count(*) FILTER (channel = 'legal') AS legal,
        count(DISTINCT sender_id) AS senders, count(DISTINCT receiver_id) AS receivers,
        count(DISTINCT receiver_id) FILTER (channel = 'crypto') AS crypto_receivers FROM w GROUP BY case_id""",
    ),
    (
        "small",
        ["w"],
        f"""SELECT case_id, count(*) FILTER (CAST(amount AS DOUBLE) < mean * {_d(0.35)}) AS parts FROM
        (SELECT case_id, amount, CAST(sum(amount) OVER (PARTITION BY case_id) AS DOUBLE) / count(*) OVER (PARTITION BY case_id) AS mean
         FROM w) GROUP BY case_id""",
    ),
    (
        "node",
        ["edge"],
        "SELECT case_id, src AS v FROM edge UNION SELECT case_id, dst FROM edge",
    ),
    (
        "shape",
        ["node", "edge"],
        """SELECT case_id, nodes, edges, CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1))::DOUBLE ELSE 0 END AS density,
        hub / greatest(edges, 1)::DOUBLE AS hub_share FROM (SELECT case_id, count(*) AS nodes FROM node GROUP BY 1)
        JOIN (SELECT case_id, max(n) AS hub, CAST(sum(n) AS BIGINT) AS edges FROM
              (SELECT case_id, dst, count(*) AS n FROM edge GROUP BY 1, 2) GROUP BY 1) USING (case_id)""",
    ),
    (
        "walk_to",
        ["edge"],
        """SELECT case_id, v AS origin, v FROM node UNION
        SELECT t.case_id, t.origin, CASE WHEN e.src = t.v THEN e.dst ELSE e.src END FROM walk_to t JOIN edge e
        ON e.case_id = t.case_id AND (e.src = t.v OR e.dst = t.v)""",
    ),
    (
        "comps",
        ["node", "walk_to"],
        """SELECT case_id, count(DISTINCT root) AS components FROM
        (SELECT case_id, v, min(origin) AS root FROM walk_to GROUP BY 1, 2) GROUP BY 1""",
    ),
    *_walk_levels(8),
    (
        "depth",
        ["front8"],
        "SELECT case_id, CAST(max(k) AS INTEGER) AS walk_depth FROM ("
        + " UNION ALL ".join(f"SELECT DISTINCT case_id, {k} AS k FROM front{k}" for k in range(1, 9))
        + ") GROUP BY case_id",
    ),
    (
        "top",
        ["w"],
        """SELECT case_id, CAST(max(v) AS DOUBLE) AS top1, CAST(sum(v) FILTER (rn <= 10) AS DOUBLE) AS top10 FROM
        (SELECT case_id, sender_id, sum(amount) AS v, row_number() OVER (PARTITION BY case_id ORDER BY sum(amount) DESC, sender_id) AS rn
         FROM w GROUP BY 1, 2) GROUP BY 1""",
    ),
    (
        "cops_raw",
        ["tot", "top", "shape", "gaps"],
        f"""SELECT case_id, events::{D} AS tx_count_total, greatest(2, nodes)::{D} AS unique_counterparties,
        greatest(1, senders)::{D} AS new_clients_current, greatest(1, floor(senders::{D} * {_d(0.82)})) AS new_clients_previous,
        least(floor(senders::{D} * {_d(0.31)}), senders) AS referred_clients_current, greatest(1, total) AS incoming_funds,
        paid AS payouts_total, least(1, top1 / greatest(1, total)) AS top1_wallet_share,
        least(1, top10 / greatest(1, total)) AS top10_wallet_share,
        {_clip(f'span_hours / 24 * {_d(2.5)}', 1.0, 365.0)} AS avg_holding_days, least(1, senders / events::{D}) AS repeat_investor_share,
        {_clip('log2(greatest(nodes, 2)) + 1', 1.0, 30.0)} AS max_referral_depth
        FROM tot JOIN top USING (case_id) JOIN shape USING (case_id) JOIN gaps USING (case_id)""",
    ),
    (
        "cops",
        ["cops_raw"],
        "SELECT case_id, "
        + ", ".join(f"{_clip(n, low, high)} AS {n}" for n, (low, high) in catalog.OPERATIONAL_BOUNDS.items())
        + " FROM cops_raw",
    ),
    ("cfeat", ["cops"], _features("cops", "case_id")),
    (
        "branch",
        ["cfeat", "gaps", "shape", "comps"],
        f"""SELECT cfeat.*, n_events, avg_delta_minutes, nodes, edges, density, {_PROXY} AS tab,
        {_sigmoid(f'{_d(0.55)} * n_events / span_hours + {_d(2.1)} * gap_density - {_d(1.8)}')} AS seq,
        {_sigmoid(f"{_d(1.8)} * hub_share + {_d(1.1)} * density + CASE WHEN components <= 2 THEN {_d(0.3)} ELSE {_d(-0.1)} END")} AS gr
        FROM cfeat JOIN gaps USING (case_id) JOIN shape USING (case_id) JOIN comps USING (case_id)""",
    ),
    (
        "labels_",
        ["tot", "small", "depth"],
        f"""SELECT case_id, CAST(walk_depth >= 4 AND legal >= 3 AS INTEGER) AS is_legal_layering,
        CAST(legal > 0 AND crypto > 0 AS INTEGER) AS is_legal_to_crypto_bridge,
        CAST(crypto >= 6 AND crypto_receivers >= 4 AS INTEGER) AS is_crypto_mixing,
        CAST(receivers >= 5 AND parts >= greatest(4, events // 3) AS INTEGER) AS is_structured_splitting,
        CAST(paid / greatest(total, 1) >= {_d(0.62)} AND events >= 6 AS INTEGER) AS is_cash_out
        FROM tot JOIN small USING (case_id) JOIN depth USING (case_id)""",
    ),
    (
        "scored",
        ["branch", "labels_"],
        f"""SELECT *, CASE WHEN global_risk >= 0.85 THEN 'CRITICAL' WHEN global_risk >= 0.70 THEN 'HIGH'
        WHEN global_risk >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM (SELECT *,
        {_clip(f'{_d(0.58)} * tab + {_d(0.22)} * seq + {_d(0.2)} * gr', 0.0, 1.0)} AS global_risk,
        {_clip(f'{_d(0.2)} + {_d(0.55)} * gr + {_d(0.25)} * tab + {_d(0.35)} * is_legal_layering', 0.0, 1.0)} AS p_legal_layering,
        {_clip(f'{_d(0.2)} + {_d(0.45)} * seq + {_d(0.35)} * tab + {_d(0.35)} * is_legal_to_crypto_bridge', 0.0, 1.0)}
          AS p_legal_to_crypto_bridge,
        {_clip(f'{_d(0.2)} + {_d(0.55)} * gr + {_d(0.25)} * seq + {_d(0.35)} * is_crypto_mixing', 0.0, 1.0)} AS p_crypto_mixing,
        {_clip(f'{_d(0.2)} + {_d(0.4)} * seq + {_d(0.35)} * tab + {_d(0.35)} * is_structured_splitting', 0.0, 1.0)}
          AS p_structured_splitting,
        {_clip(f'{_d(0.2)} + {_d(0.45)} * tab + {_d(0.25)} * seq + {_d(0.35)} * is_cash_out', 0.0, 1.0)} AS p_cash_out
        FROM branch JOIN labels_ USING (case_id))""",
    ),
    (
        "told",
        ["scored"],
        """SELECT *, printf('Case %s has global risk %.3f (%s). Strongest typology: %s.', case_id, global_risk, risk_band, CASE
        greatest(p_legal_layering, p_legal_to_crypto_bridge, p_crypto_mixing, p_structured_splitting, p_cash_out)
        WHEN p_legal_layering THEN 'LEGAL_LAYERING' WHEN p_legal_to_crypto_bridge THEN 'LEGAL_TO_CRYPTO_BRIDGE'
        WHEN p_crypto_mixing THEN 'CRYPTO_MIXING' WHEN p_structured_splitting THEN 'STRUCTURED_SPLITTING'
        ELSE 'CASH_OUT' END) AS summary, 0.55 + 0.35::DOUBLE * global_risk AS confidence FROM scored""",
    ),
    (
        "feature_rows",
        ["cfeat"],
        "SELECT case_id, string_agg(feature, ',' ORDER BY rn) AS top_features, max(value) FILTER (rn = 1) AS top_value FROM ("
        "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY abs(value) DESC, place) AS rn FROM ("
        + " UNION ALL ".join(
            f"SELECT case_id, '{n}' AS feature, {i} AS place, {n} AS value FROM cfeat" for i, n in enumerate(catalog.FEATURES)
        )
        + ")) WHERE rn <= 5 GROUP BY case_id",
    ),
    (
        "reach",
        ["edge"],
        """SELECT case_id, src AS s, dst AS t, 1 AS d FROM edge UNION
        SELECT r.case_id, r.s, e.dst, r.d + 1 FROM reach r JOIN edge e ON e.case_id = r.case_id AND e.src = r.t WHERE r.d < 9""",
    ),
    ("dist", ["reach"], "SELECT case_id, s, t, min(d) AS d FROM reach WHERE s <> t GROUP BY ALL"),
    (
        "path",
        ["dist"],
        """SELECT case_id, src AS s, dst AS t, 1 AS d FROM edge UNION ALL
        SELECT p.case_id, p.s, e.dst, p.d + 1 FROM path p JOIN edge e ON e.case_id = p.case_id AND e.src = p.t
        JOIN dist ON dist.case_id = p.case_id AND dist.s = p.s AND dist.t = e.dst AND dist.d = p.d + 1""",
    ),
    ("sigma", ["path"], "SELECT case_id, s, t, d, count(*) AS n FROM path GROUP BY ALL"),
    (
        "hub",
        ["edge", "node"],
        """SELECT case_id, v AS hub_node, deg / greatest(m, 1)::DOUBLE AS hub_in_degree_share, n FROM (SELECT case_id, v,
        coalesce(deg, 0) AS deg, sum(coalesce(deg, 0)) OVER (PARTITION BY case_id) AS m, count(*) OVER (PARTITION BY case_id) AS n,
        row_number() OVER (PARTITION BY case_id ORDER BY coalesce(deg, 0) DESC, v) AS rn FROM node LEFT JOIN
        (SELECT case_id, dst AS v, count(*) AS deg FROM edge GROUP BY 1, 2) USING (case_id, v)) WHERE rn = 1""",
    ),
    (
        "through",
        ["sigma", "hub"],
        """SELECT h.case_id, sum(a.n * b.n / c.n::DOUBLE) AS total FROM hub h JOIN sigma a ON a.case_id = h.case_id AND a.t = h.hub_node
        JOIN sigma b ON b.case_id = h.case_id AND b.s = h.hub_node
        JOIN sigma c ON c.case_id = h.case_id AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY 1""",
    ),
    (
        "dirty",
        ["ev_raw"],
        """SELECT CASE WHEN pos % 103 = 0 THEN '' ELSE event_id END AS event_id, pos,
        CASE WHEN pos % 83 = 0 OR pos % 89 = 0 THEN NULL ELSE ts END AS ts, case_id,
        CASE WHEN pos % 107 = 0 THEN '' ELSE sender_id END AS sender_id, receiver_id,
        CASE WHEN pos % 127 = 0 OR pos % 79 = 0 THEN NULL WHEN pos % 97 = 0 THEN -amount ELSE amount END AS amount,
        CASE WHEN pos % 101 = 0 THEN '' ELSE 'USD' END AS currency, sender_type, 'wallet' AS receiver_type,
        CASE WHEN event_type = 'error' THEN 'wire' ELSE channel END AS channel,
        CASE WHEN pos % 109 = 0 THEN '' ELSE 'KZ' END AS jurisdiction,
        CASE WHEN pos % 113 = 0 THEN '' WHEN event_type IN ('purchase', 'signup') THEN 'token' ELSE 'fiat' END AS asset_type FROM ev_raw""",
    ),
]
_ORDER = [name for name, _, _ in _BLOCKS]
_NEEDS = {name: needs for name, needs, _ in _BLOCKS}
_BODY = {name: body for name, _, body in _BLOCKS}


def _closure(names: list[str]) -> set[str]:
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += _NEEDS[name]
    return found


def _with(names: str, body: str) -> str:
    needed = _closure(names.split())
    blocks = ",\n".join(f"{name} AS ({_BODY[name]})" for name in _ORDER if name in needed)
    return f"WITH RECURSIVE {blocks}\n{body}"


def _round(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_PROBS = [f"p_{n.lower()}" for n in catalog.TYPOLOGIES]
_METRICS = (
    "total_inflow total_outflow crypto_inflow crypto_outflow physical_inflow_ratio crypto_exposure_ratio dependency_ratio "
    "avg_holding_time concentration_index entropy_of_flows legal_inflow_ratio exchange_inflow_ratio total_transactions "
    "inflow_count outflow_count unique_counterparties total_volume"
).split()
_CORRELATIONS = (
    "corr(referral_ratio, growth_rate) AS corr_referral_growth, "
    "corr(centralization_index, gini_coefficient) AS corr_centralization_gini"
)

STREAM_WINDOWS = """
    SELECT case_id, count(*) AS n_events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM w GROUP BY case_id"""

_COARSE = f"""coarse AS (SELECT label, is_test, round({_PROXY}, 3) AS score FROM split)"""
# The greatest over starts of the least over ends of the means between them: the isotonic curve, without pooling.
_ISOTONIC = """
    dist AS (SELECT score, count(*) AS n, count(*) FILTER (label = 1) AS p FROM coarse WHERE NOT is_test GROUP BY score),
    summed AS (SELECT *, row_number() OVER o AS i, sum(n) OVER o AS cn, sum(p) OVER o AS cp FROM dist WINDOW o AS (ORDER BY score)),
    means AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.p)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m FROM summed a JOIN summed b ON b.i >= a.i),
    least_of AS (SELECT k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS v FROM means),
    risen AS (SELECT i, max(v) AS v FROM least_of GROUP BY i),
    iso AS (SELECT min(score) AS low, max(score) AS high, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, v AS value
        FROM summed JOIN risen USING (i) GROUP BY v)"""
_PLATT = f"""
    totals AS (SELECT count(*) FILTER (label = 1)::{D} AS pos, count(*) FILTER (label = 0)::{D} AS neg FROM coarse WHERE NOT is_test),
    aim AS (SELECT score AS x, n::{D} AS n, p * (pos + 1) / (pos + 2) + (n - p) / (neg + 2) AS t FROM dist, totals),
    steps(k, a, b) AS (
        SELECT 0, 0::{D}, ln((pos + 1) / (neg + 1)) FROM totals
        UNION ALL
        SELECT k + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
        FROM (SELECT k, a, b, sum((n * q - t) * x) AS g0, sum(n * q - t) AS g1, sum(n * q * (1 - q) * x * x) AS h00,
            sum(n * q * (1 - q) * x) AS h01, sum(n * q * (1 - q)) AS h11
            FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS q FROM steps, aim WHERE k < 20) GROUP BY k, a, b)
    ),
    platt AS (SELECT a AS slope, b AS "offset" FROM steps WHERE k = 20)"""
_ISO_VALUE = """coalesce(
    (SELECT max(value) FROM iso WHERE score BETWEEN low AND high),
    (SELECT l.value + (h.value - l.value) * (score - l.high) / (h.low - l.high)
        FROM (SELECT max_by(value, high) AS value, max(high) AS high FROM iso WHERE high < score) l,
             (SELECT min_by(value, low) AS value, min(low) AS low FROM iso WHERE low > score) h),
    (SELECT CASE WHEN score < min(low) THEN min(value) ELSE max(value) END FROM iso))"""
_REPORTED = f"""ways AS (
        SELECT 'raw' AS method, label, score AS p FROM coarse WHERE is_test
        UNION ALL SELECT 'platt', label, 1 / (1 + exp(-(slope * score + "offset"))) FROM coarse, platt WHERE is_test
        UNION ALL SELECT 'isotonic', label, {_ISO_VALUE} FROM coarse WHERE is_test)"""

_DRIFT = f"""
    long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::{D} AS value, is_test FROM split" for f in catalog.FEATURES)}),
    edges AS (SELECT feature, [{", ".join(f"quantile_cont(value, {k / 10})" for k in range(1, 10))}] AS e FROM long WHERE NOT is_test GROUP BY feature),
    celled AS (SELECT feature, value, is_test, len(list_filter(e, lambda x: x < value)) AS cell FROM long JOIN edges USING (feature)),
    sizes AS (SELECT feature, count(*) FILTER (NOT is_test) AS r, count(*) FILTER (is_test) AS c FROM long GROUP BY feature),
    shares AS (SELECT feature, greatest(count(*) FILTER (NOT is_test) / max(r)::{D}, 1e-4) AS a, greatest(count(*) FILTER (is_test) / max(c)::{D}, 1e-4) AS b
        FROM celled JOIN sizes USING (feature) GROUP BY feature, cell),
    psi AS (SELECT feature, sum((b - a) * ln(b / a)) AS v FROM shares GROUP BY feature),
    gaps_ AS (SELECT feature, max(abs(fr / r::{D} - fc / c::{D})) AS ks FROM (SELECT feature, value,
        sum(count(*) FILTER (NOT is_test)) OVER (PARTITION BY feature ORDER BY value) AS fr,
        sum(count(*) FILTER (is_test)) OVER (PARTITION BY feature ORDER BY value) AS fc FROM long GROUP BY feature, value) JOIN sizes USING (feature) GROUP BY feature)
    SELECT feature, r AS n_reference, c AS n_current, round(v, 6) AS stability_index, round(ks, 6) AS ks
    FROM sizes JOIN psi USING (feature) JOIN gaps_ USING (feature)"""
# Every positive against every negative, once per score.
_DELONG = f"""
    two AS (SELECT row_number() OVER () AS id, label, round({_PROXY}, 4) AS a, round(centralization_index, 4) AS b FROM lab),
    fought AS (SELECT p.id AS p, n.id AS n, CASE WHEN p.a > n.a THEN 1 WHEN p.a = n.a THEN 0.5::{D} ELSE 0 END AS a,
        CASE WHEN p.b > n.b THEN 1 WHEN p.b = n.b THEN 0.5::{D} ELSE 0 END AS b FROM two p JOIN two n ON p.label = 1 AND n.label = 0),
    pos AS (SELECT avg(a) AS a, avg(b) AS b FROM fought GROUP BY p),
    neg AS (SELECT avg(a) AS a, avg(b) AS b FROM fought GROUP BY n),
    told AS (SELECT (SELECT avg(a) FROM pos) AS x, (SELECT avg(b) FROM pos) AS y,
        sqrt((SELECT var_samp(a - b) / count(*) FROM pos) + (SELECT var_samp(a - b) / count(*) FROM neg)) AS d)
    SELECT round(x, 6) AS auc_first, round(y, 6) AS auc_second, round(x - y, 6) AS difference, round(d, 6) AS deviation, round((x - y) / d, 6) AS z FROM told"""

# Every row once per replicate, with a weight from its digest; the areas by a running sum over distinct scores.
_MASS = ("1", "2", "2.5", "8 / 3.0", "65 / 24.0", "163 / 60.0", "1957 / 720.0", "685 / 252.0")
_TIMES = " + ".join(f"(u >= round(65536 * exp(-1::{D}) * ({m})::{D}))::BIGINT" for m in _MASS)


def _resampled(sides: dict[str, tuple[str, float]]) -> str:
    scores = " UNION ALL ".join(f"SELECT '{n}' AS side, entity_id, label, round({s}, 4) AS s, {cut} AS cut FROM lab" for n, (s, cut) in sides.items())
    return f"""
    sides AS ({scores}),
    digits AS (SELECT side, label, s, cut, b, ('0x' || substr(md5(entity_id || ':7:' || (b // 8)), CAST(4 * (b % 8) + 1 AS INTEGER), 4))::BIGINT AS u
        FROM sides, range(0, 201) AS r(b)),
    weighed AS (SELECT side, label, s, cut, b, CASE WHEN b = 0 THEN 1 ELSE {_TIMES} END AS w FROM digits),
    levels AS (SELECT side, b, s, any_value(cut) AS cut, coalesce(sum(w) FILTER (label = 1), 0)::{D} AS tp, coalesce(sum(w) FILTER (label = 0), 0)::{D} AS fp
        FROM weighed GROUP BY side, b, s),
    summed AS (SELECT *, sum(tp) OVER (PARTITION BY side, b ORDER BY s DESC) AS tps FROM levels),
    drawn AS (SELECT side, b, sum(tp) AS p, sum(fp) AS n, sum(fp * (tps - tp / 2)) AS won, coalesce(sum(tp) FILTER (s > cut), 0) AS hit,
        coalesce(sum(fp) FILTER (s > cut), 0) AS wrong FROM summed GROUP BY side, b),
    told AS (SELECT side, b, unnest(['roc_auc', 'accuracy', 'recall', 'precision']) AS metric, unnest([won / nullif(p * n, 0),
        (hit + n - wrong) / nullif(p + n, 0), hit / nullif(p, 0), hit / nullif(hit + wrong, 0)]) AS v FROM drawn)"""


_INTERVAL = """metric, round(max(v) FILTER (b = 0), 6) AS estimate, round(stddev_samp(v) FILTER (b > 0), 6) AS deviation,
    round(quantile_cont(v, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (b > 0), 6) AS high, count(v) FILTER (b > 0) AS n_used"""

# Windows stand on the clock; those are closed that end no later than the latest event less an hour.
_HOPPING = f"""
    , hops AS (SELECT case_id, unnest(range(0, {WINDOW_HOURS}, 4)) AS back, ts, amount, channel FROM ev),
    windows_ AS (SELECT case_id, (epoch_us(ts) // 14400000000 * 14400000000 - back * 3600000000)::BIGINT AS window_start, ts, amount, channel FROM hops)
    SELECT case_id, window_start AS window_start_us, count(*) AS n_events, round(sum(amount)::{D}, 6) AS amount_total,
        epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) FILTER (channel = 'crypto') AS crypto_events
    FROM windows_ WHERE window_start + {WINDOW_HOURS} * 3600000000 <= (SELECT epoch_us(max(ts)) FROM ev) - 3600000000
    GROUP BY case_id, window_start"""

ORACLES: dict[str, str] = {
    "read_transactions": _with(
        "tx",
        """SELECT sender_id, count(*) AS n_tx, round(CAST(sum(amount) AS DOUBLE), 6) AS amount,
        epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM tx GROUP BY sender_id""",
    ),
    "labeled_dataset_from_ops": _with("lab", f"SELECT entity_id AS id, label, {_round(catalog.FEATURES)} FROM lab"),
    "explode_cases": _with(
        "ev_raw",
        """SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id, pos // 64 ORDER BY pos) - 1 AS INTEGER) AS pos, event_id,
        sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, channel FROM ev_raw""",
    ),
    "normalize_events": _with(
        "dirty",
        """SELECT event_id, currency, sender_id, receiver_id, sender_type, receiver_type, channel, jurisdiction, asset_type,
        CAST(amount AS DOUBLE) AS amount, epoch_us(ts) AS ts_us, case_id FROM dirty""",
    ),
    "event_violations": _with(
        "dirty",
        """SELECT * FROM (SELECT event_id, case_id, CASE
        WHEN pos % 127 = 0 AND pos % 83 = 0 THEN 'Missing event fields: [''amount'', ''ts'']'
        WHEN pos % 127 = 0 THEN 'Missing event fields: [''amount'']' WHEN pos % 83 = 0 THEN 'Missing event fields: [''ts'']'
        WHEN pos % 89 = 0 THEN 'Invalid isoformat string: ''not-a-time'''
        WHEN pos % 79 = 0 THEN 'could not convert string to float: ''12x'''
        WHEN event_id = '' THEN 'event_id must be non-empty.' WHEN amount <= 0 THEN 'amount must be > 0.'
        WHEN sender_id = '' OR receiver_id = '' THEN 'sender_id and receiver_id must be non-empty.'
        WHEN sender_id = receiver_id THEN 'sender_id and receiver_id must be different.'
        WHEN channel NOT IN ('legal', 'crypto') THEN 'channel must be one of [''crypto'', ''legal''].'
        WHEN currency = '' THEN 'currency must be non-empty.' WHEN jurisdiction = '' THEN 'jurisdiction must be non-empty.'
        WHEN asset_type = '' THEN 'asset_type must be non-empty.' END AS reason FROM dirty) WHERE reason IS NOT NULL""",
    ),
    "ops_quarantine": _with(
        "ops_checked",
        f"SELECT entity_id, {_round(['tx_count_total', 'incoming_funds'])}, reason FROM ops_checked WHERE reason IS NOT NULL",
    ),
    "feature_quarantine": _with(
        "ops_all",
        f"""SELECT entity_id, round(payout_dependency, 6) AS payout_dependency, reason FROM (SELECT *, CASE
        {_reason({'payout_dependency': catalog.FEATURE_BOUNDS['payout_dependency']}, 'Feature')} END AS reason FROM
        (SELECT entity_id, payouts_total / greatest(incoming_funds, 1) AS payout_dependency FROM ops_all)) WHERE reason IS NOT NULL""",
    ),
    "dataset_quality_gate": _with(
        "overlap",
        f"""SELECT "check", round(value, 6) AS value, CASE WHEN "check" LIKE 'corr%' THEN coalesce(value > 0.2, false)
        WHEN "check" = 'label_share' THEN value BETWEEN 0.48 AND 0.52
        WHEN "check" = 'borderline_share' THEN abs(value - {_d(0.15)}) <= {_d(0.02)}
        WHEN "check" LIKE 'overlap%' THEN value > 0.05 ELSE value = 0 END AS ok FROM (
        SELECT 'non_finite_rows' AS "check", count(*) FILTER (growth_rate IS NULL)::DOUBLE AS value FROM lab UNION ALL """
        + " UNION ALL ".join(
            f"SELECT 'out_of_bounds:{n}', count(*) FILTER ({n} < {low} OR {n} > {high})::DOUBLE FROM lab"
            for n, (low, high) in catalog.FEATURE_BOUNDS.items()
        )
        + """ UNION ALL SELECT 'corr_referral_growth', corr(referral_ratio, growth_rate) FROM lab
        UNION ALL SELECT 'corr_centralization_gini', corr(centralization_index, gini_coefficient) FROM lab
        UNION ALL SELECT 'label_share', avg(label) FROM lab
        UNION ALL SELECT 'borderline_share', avg(CAST(is_borderline AS INTEGER)) FROM lab
        UNION ALL SELECT 'overlap:' || feature, overlap_ratio FROM overlap)""",
    ),
    "class_overlap": _with(
        "overlap", f"SELECT feature, {_round(['low0', 'high0', 'low1', 'high1', 'overlap_ratio'])} FROM overlap"
    ),
    "dataset_report": _with(
        "lab",
        f"""SELECT {_round(['rows', 'pyramid_share', 'borderline_share', 'corr_referral_growth', 'corr_centralization_gini'])} FROM
        (SELECT count(*)::DOUBLE AS rows, avg(label) AS pyramid_share, avg(CAST(is_borderline AS INTEGER)) AS borderline_share,
        {_CORRELATIONS} FROM lab)""",
    ),
    "leakage_check": _with(
        "split",
        """SELECT "check", value, value = 0 AS ok FROM (
        SELECT 'shared_keys' AS "check", count(*)::DOUBLE AS value FROM split a JOIN split b USING (entity_id)
        WHERE a.is_test AND NOT b.is_test UNION ALL
        SELECT 'non_finite_rows', count(*) FILTER (growth_rate IS NULL OR label IS NULL)::DOUBLE FROM split UNION ALL
        SELECT 'label_in_features', 0.0::DOUBLE)""",
    ),
    "entity_operational": _with("ops_all", f"SELECT entity_id, {_round(catalog.OPERATIONAL)} FROM ops_all"),
    "log_operational": _with(
        "tx",
        f"""SELECT {_round(catalog.OPERATIONAL)} FROM (SELECT {_d('(SELECT count(*) FROM tx)')} AS tx_count_total,
        {_d('(SELECT count(*) FROM (SELECT sender_id FROM tx UNION SELECT receiver_id FROM tx))')} AS unique_counterparties,
        {_client_facts('count(*)')}, CAST(sum(v) AS DOUBLE) AS incoming_funds, {_d(0)} AS payouts_total,
        CAST(max(v) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top1_wallet_share,
        CAST(sum(v) FILTER (rn <= 10) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top10_wallet_share
        FROM (SELECT sender_id, sum(amount) AS v, row_number() OVER (ORDER BY sum(amount) DESC, sender_id) AS rn FROM tx GROUP BY 1))""",
    ),
    "sender_concentration": _with(
        "inflow",
        """SELECT e AS entity_id, round(incoming, 6) AS incoming_funds, round(top1 / incoming, 6) AS top1_wallet_share,
        round(top10 / incoming, 6) AS top10_wallet_share FROM inflow""",
    ),
    "entity_features": _with("feat", f"SELECT entity_id, {_round(catalog.FEATURES)} FROM feat"),
    "tabular_proxy": _with("feat", f"SELECT entity_id, round({_PROXY}, 6) AS tabular_score FROM feat"),
    "company_metrics": _with("met", f"SELECT company_id, {_round(_METRICS)} FROM met"),
    "fifo_holding_time": _with("hold", f"SELECT company_id, {_round(['avg_holding_time'])} FROM hold"),
    "company_concentration": _with("conc", f"SELECT company_id, {_round(['concentration_index'])} FROM conc"),
    "flow_entropy": _with("entr", f"SELECT company_id, {_round(['entropy_of_flows'])} FROM entr"),
    "daily_flow": _with(
        "flow",
        """SELECT company_id, strftime(d, '%Y-%m-%d') AS day, round(CAST(i AS DOUBLE), 6) AS inflow,
        round(CAST(o AS DOUBLE), 6) AS outflow FROM flow""",
    ),
    "inflow_structure": _with(
        "core",
        """SELECT company_id, round(CASE WHEN t > 0 THEN physical_inflow_ratio / t ELSE physical_inflow_ratio END, 6) AS physical_share,
        round(CASE WHEN t > 0 THEN legal_inflow_ratio / t ELSE legal_inflow_ratio END, 6) AS legal_share,
        round(CASE WHEN t > 0 THEN exchange_inflow_ratio / t ELSE exchange_inflow_ratio END, 6) AS exchange_share
        FROM (SELECT *, physical_inflow_ratio + legal_inflow_ratio + exchange_inflow_ratio AS t FROM core)""",
    ),
    "counterparty_network": _with(
        "led",
        """SELECT company_id, name AS counterparty_name, kind AS counterparty_type,
        CASE WHEN dir = 'in' THEN name ELSE CAST(company_id AS VARCHAR) END AS src,
        CASE WHEN dir = 'in' THEN CAST(company_id AS VARCHAR) ELSE name END AS dst, round(CAST(v AS DOUBLE), 6) AS volume, tx_count,
        round(0.5 + 3 * CAST(v AS DOUBLE) / max(CAST(v AS DOUBLE)) OVER (PARTITION BY company_id), 6) AS width
        FROM (SELECT company_id, name, kind, dir, sum(amount) AS v, count(*) AS tx_count FROM led GROUP BY ALL)
        JOIN (SELECT company_id, name FROM (SELECT company_id, name,
              row_number() OVER (PARTITION BY company_id ORDER BY sum(amount) DESC, name) AS rn FROM led GROUP BY 1, 2) WHERE rn <= 12)
        USING (company_id, name)""",
    ),
    "metrics_long": _with(
        "met",
        " UNION ALL ".join(f"SELECT company_id, '{m}' AS metric, round({m}, 6) AS value, {_display(m)} AS display FROM met" for m in _METRICS),
    ),
    "company_risk": _with(
        "crisk",
        "SELECT company_id, round(probability, 6) AS probability, risk_level, "
        "CASE risk_level "
        + " ".join(f"WHEN '{level}' THEN '{label}'" for level, label, _ in catalog.COMPANY_LEVEL_LABELS)
        + " END AS risk_label, CASE risk_level "
        + " ".join(f"WHEN '{level}' THEN '{sign}'" for level, _, sign in catalog.COMPANY_LEVEL_LABELS)
        + " END AS risk_sign, "
        + _round([f"{kind}_{n}" for kind in ("contribution", "normalized") for n in _FACTORS])
        + " FROM crisk",
    ),
    "company_findings": _with(
        "crisk",
        """SELECT company_id, round(probability, 6) AS probability, risk_level,
        CASE WHEN physical_inflow_ratio * 100 >= 60 THEN 'red' WHEN physical_inflow_ratio * 100 >= 35 THEN 'yellow' ELSE 'green' END AS physical_band,
        CASE WHEN crypto_exposure_ratio * 100 >= 30 THEN 'red' WHEN crypto_exposure_ratio * 100 >= 10 THEN 'yellow' ELSE 'green' END AS crypto_band,
        CASE WHEN dependency_ratio >= 0.8 THEN 'red' WHEN dependency_ratio >= 0.5 THEN 'yellow' ELSE 'green' END AS dependency_band,
        CASE WHEN avg_holding_time < 30 THEN 'red' WHEN avg_holding_time < 60 THEN 'yellow' ELSE 'green' END AS holding_band,
        CASE WHEN concentration_index * 100 >= 40 THEN 'red' WHEN concentration_index * 100 >= 25 THEN 'yellow' ELSE 'green' END AS concentration_band,
        CASE WHEN probability >= 0.75 THEN 'priority_check' WHEN probability >= 0.55 THEN 'deep_analysis'
        WHEN probability >= 0.30 THEN 'monitoring' ELSE 'no_action' END AS conclusion, """
        + _narrative()
        + " AS narrative FROM crisk",
    ),
    "factor_contributions": _with(
        "crisk",
        "SELECT company_id, factor, round(c, 6) AS contribution, CASE WHEN c >= 0.15 THEN 'red' WHEN c >= 0.08 THEN 'orange' "
        "WHEN c >= 0.04 THEN 'yellow' ELSE 'green' END AS severity FROM ("
        + " UNION ALL ".join(f"SELECT company_id, '{n}' AS factor, contribution_{n} AS c FROM crisk" for n in _FACTORS)
        + ")",
    ),
    "case_window": _with(
        "w",
        """SELECT case_id AS request_id, CASE WHEN CAST(split_part(substr(case_id, 2), '-', 1) AS INTEGER) % 3 = 0
        THEN 'case-' || strftime(max(ts), '%Y%m%d%H%M%S') ELSE case_id END AS resolved_case_id,
        count(*) AS n_events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM w GROUP BY case_id""",
    ),
    "case_operational": _with("cops", f"SELECT case_id, {_round(catalog.OPERATIONAL)} FROM cops"),
    "event_gaps": _with(
        "gaps",
        f"SELECT case_id, n_events, short_gaps, {_round(['gap_density', 'avg_delta_minutes', 'span_hours'])} FROM gaps",
    ),
    "sequence_score": _with("branch", "SELECT case_id, round(seq, 6) AS sequence_score FROM branch"),
    "case_graph_stats": _with("shape", f"SELECT case_id, nodes, edges, {_round(['density', 'hub_share'])} FROM shape"),
    "case_components": _with("comps", "SELECT case_id, components FROM comps"),
    "case_walk_depth": _with("depth", "SELECT case_id, walk_depth FROM depth"),
    "case_hub_metrics": _with(
        "through",
        """SELECT case_id, hub_node, round(hub_in_degree_share, 6) AS hub_in_degree_share,
        round(CASE WHEN n < 3 THEN 0 ELSE coalesce(total, 0) / ((n - 1) * (n - 2)) END, 6) AS hub_betweenness
        FROM hub LEFT JOIN through USING (case_id)""",
    ),
    "graph_score": _with("branch", "SELECT case_id, round(gr, 6) AS graph_score FROM branch"),
    "typology_labels": _with("labels_", "SELECT * FROM labels_"),
    "typology_probs": _with("scored", f"SELECT case_id, {_round(_PROBS)} FROM scored"),
    "score_cases": _with("scored", f"SELECT case_id, round(global_risk, 6) AS global_risk, risk_band, {_round(_PROBS)} FROM scored"),
    # Here the events of failed cases are dropped before windowing, not the single bad events.
    "score_batch_failures": _with("scored", "").replace(
        "SELECT * FROM ev_raw WHERE sender_id <> receiver_id",
        "SELECT * FROM ev_raw WHERE case_id NOT IN (SELECT case_id FROM ev_raw WHERE sender_id = receiver_id)",
    )
    + """SELECT case_id, NULL::VARCHAR AS error, round(global_risk, 6) AS global_risk FROM scored UNION ALL
    SELECT DISTINCT case_id, 'sender_id and receiver_id must be different.', NULL::DOUBLE FROM ev_raw WHERE sender_id = receiver_id""",
    # Requests are cases named by part; a supplied share stands in for the derived one.
    "score_requests": _with("scored", "").replace(
        "SELECT * FROM ev_raw WHERE sender_id <> receiver_id",
        """SELECT * REPLACE (case_id || '#' || (pos // 64) AS case_id) FROM ev_raw WHERE (pos // 64) % 5 <> 4
        AND case_id || '#' || (pos // 64) NOT IN (SELECT case_id || '#' || (pos // 64) FROM ev_raw WHERE sender_id = receiver_id)""",
    ).replace(
        f"{_PROXY} AS tab",
        f"""CASE WHEN split_part(case_id, '#', 2)::BIGINT % 3 = 1 THEN {_clip(
            f"(split_part(case_id, '#', 2)::BIGINT % 5) / {_d(5)} * {_d(0.35)} + (split_part(case_id, '#', 2)::BIGINT % 7) / {_d(7)} * {_d(0.35)}"
            f" + (split_part(case_id, '#', 2)::BIGINT % 4) / {_d(4)} * {_d(0.30)}", 0.0, 1.0)} ELSE {_PROXY} END AS tab""",
    )
    + """SELECT case_id, NULL::VARCHAR AS error, round(global_risk, 6) AS global_risk FROM scored UNION ALL
    SELECT case_id || '#' || (pos // 64), max(CASE WHEN (pos // 64) % 5 = 4 THEN 'window_hours must be > 0.'
        ELSE 'sender_id and receiver_id must be different.' END), NULL::DOUBLE
    FROM ev_raw GROUP BY 1, (pos // 64) % 5 = 4 HAVING (pos // 64) % 5 = 4 OR bool_or(sender_id = receiver_id)""",
    "explain_cases": _with(
        "told feature_rows",
        f"""SELECT case_id, summary, top_features, round(top_value, 6) AS top_value, n_events::{D} AS event_count,
        round(avg_delta_minutes, 6) AS avg_delta_minutes, {_d(WINDOW_HOURS)} AS window_hours, nodes::{D} AS nodes,
        edges::{D} AS edges, round(density, 6) AS density, round(confidence, 6) AS confidence
        FROM told JOIN feature_rows USING (case_id)""",
    ),
    "alert_queue": _with(
        "told",
        """SELECT case_id, round(global_risk, 6) AS global_risk, risk_band, summary, round(confidence, 6) AS confidence
        FROM (SELECT * FROM told ORDER BY told.global_risk DESC, case_id LIMIT 100)""",
    ),
    "stream_case_windows": _with("w", STREAM_WINDOWS),
    "stream_case_state": _with("w", STREAM_WINDOWS),
    "population_pca": _with(
        "pca", 'SELECT entity_id, round(pca1, 4) AS "PCA1", round(pca2, 4) AS "PCA2", label, is_borderline FROM pca'
    ),
    # Fitted to the training rows, applied to the others.
    "population_project": _with(
        "split",
        ", " + _population_map().replace("WITH RECURSIVE ", "").replace("FROM lab)", "FROM split WHERE NOT is_test)")
        .replace("SELECT entity_id, label, is_borderline,", "pca AS (SELECT entity_id,").replace("FROM lab, s, first, second", "FROM split, s, first, second WHERE is_test)")
        .replace("        pca AS", "        , pca AS")
        + ' SELECT entity_id, round(pca1, 4) AS "PCA1", round(pca2, 4) AS "PCA2" FROM pca',
    ),
    "load_population": _with(
        "lab",
        "SELECT label, is_borderline, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in catalog.FEATURES)
        + " FROM lab GROUP BY label, is_borderline",
    ),
    "case_bands": _with(
        "scored",
        f"""SELECT b.band, b.at_least, count(s.case_id) AS n_cases FROM (VALUES
        {", ".join(f"('{name}', {_d(limit)})" for limit, name in catalog.CASE_BANDS)}) AS b(band, at_least)
        LEFT JOIN scored s ON s.risk_band = b.band GROUP BY ALL UNION ALL
        SELECT 'LOW', NULL, count(*) FROM scored WHERE risk_band = 'LOW' HAVING count(*) > 0""",
    ),
    "typology_levels": _with(
        "scored",
        " UNION ALL ".join(
            f"SELECT '{name}' AS typology, {k} AS place, round(avg({p}), 6) AS mean_prob, count(*) FILTER ({p} >= 0.5) AS n_likely FROM scored"
            for k, (name, p) in enumerate(zip(catalog.TYPOLOGIES, _PROBS))
        ),
    ),
    "events_by_day": _with(
        "ev_raw",
        "SELECT strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS n_events, round(sum(amount)::DOUBLE, 2) AS amount FROM ev_raw GROUP BY 1",
    ),
    "stream_hopping_windows": _with("ev", _HOPPING),
    "population_layers": _with(
        "pca",
        " UNION ALL ".join(
            f"SELECT '{name}' AS layer, count(*) AS n, round(avg(pca1), 4) AS center_pca1, round(avg(pca2), 4) AS center_pca2 "
            f"FROM pca WHERE {rule} HAVING count(*) > 0"
            for name, rule in (("legit", "label = 0"), ("pyramid", "label = 1"), ("borderline", "is_borderline"))
        ),
    ),
    "feature_drift": _with("split", f", {_DRIFT}"),
    "compare_scores": _with("lab", f", {_DELONG}"),
    "bootstrap_metrics": _with("lab", f", {_resampled({'a': (_PROXY, 0.25)})} SELECT {_INTERVAL} FROM told GROUP BY metric"),
    "bootstrap_difference": _with(
        "lab",
        f""", {_resampled({'a': (_PROXY, 0.25), 'b': ('centralization_index', 0.5)})},
        gaps AS (SELECT x.b, x.metric, x.v - y.v AS v FROM told x JOIN told y ON x.side = 'a' AND y.side = 'b' AND x.b = y.b AND x.metric = y.metric)
        SELECT {_INTERVAL}, round(avg((v > 0)::INTEGER) FILTER (b > 0), 6) AS above_zero FROM gaps GROUP BY metric""",
    ),
    "profile_ranges": _with(
        "tx",
        """SELECT substr(receiver_id, 1, 1) AS side, year(ts)::INTEGER AS year, count(*) AS n_rows, count(DISTINCT sender_id) AS senders,
        round(sum(amount)::DOUBLE, 6) AS amount, TRUE AS senders_near, TRUE AS median_near FROM tx GROUP BY 1, 2""",
    ),
    "isotonic_curve": _with("split", f", {_COARSE}, {_ISOTONIC} SELECT low, high, n, positives, round(value, 6) AS value FROM iso"),
    "platt_curve": _with("split", f""", {_COARSE}, {_ISOTONIC}, {_PLATT} SELECT round(slope, 6) AS slope, round("offset", 6) AS "offset" FROM platt"""),
    "calibration_report": _with(
        "split",
        f""", {_COARSE}, {_ISOTONIC}, {_PLATT}, {_REPORTED} SELECT method, sum(n)::BIGINT AS n, round(sum(square) / sum(n), 6) AS brier,
        round(sum(gap) / sum(n), 6) AS calibration_error FROM (SELECT method, least(floor(p * 10), 9) AS bin, count(*) AS n,
        sum((p - label) * (p - label)) AS square, abs(sum(p - label)) AS gap FROM ways GROUP BY 1, 2) GROUP BY method""",
    ),
    "stratified_split": _with("split", "SELECT entity_id, label, is_test FROM split"),
    "binary_metrics": _with(
        "ranked",
        f"""SELECT round((tp + tn) / (tp + tn + fp + fn)::{D}, 6) AS accuracy, round(won / (tp + fn) / (fp + tn), 6) AS roc_auc,
        round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::{D} END, 6) AS recall_pyramid,
        round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::{D} END, 6) AS precision_pyramid, tn AS true_negatives,
        fp AS false_positives, fn AS false_negatives, tp AS true_positives FROM (SELECT
        CAST(coalesce(sum(tp) FILTER (s > 0.25), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp) FILTER (s > 0.25), 0) AS BIGINT) AS fp,
        CAST(coalesce(sum(tp) FILTER (s <= 0.25), 0) AS BIGINT) AS fn, CAST(coalesce(sum(fp) FILTER (s <= 0.25), 0) AS BIGINT) AS tn,
        sum(fp * (tps - tp / 2.0::{D})) AS won FROM ranked)""",
    ),
    "roc_curve": _with(
        "ranked",
        f"""SELECT {_d(2)} AS threshold, {_d(0)} AS fpr, {_d(0)} AS tpr UNION ALL
        SELECT round(s, 6), round(fps / n::{D}, 6), round(tps / p::{D}, 6) FROM ranked
        WHERE rn = 1 OR ntp IS NULL OR tp <> ntp OR fp <> nfp""",
    ),
    "risk_catalog": _with(
        "feat",
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, '{n}' AS name, {_d(low)} AS low, {_d(high)} AS high, round(min({n}), 6) AS seen_low, "
            f"round(max({n}), 6) AS seen_high FROM {source}"
            for kind, source, bounds in (
                ("feature", "feat", catalog.FEATURE_BOUNDS),
                ("operational", "ops", catalog.OPERATIONAL_BOUNDS),
            )
            for n, (low, high) in bounds.items()
        ),
    ),
}
