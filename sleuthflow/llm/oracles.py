"""DuckDB checks of the queries that SQL can express."""

from __future__ import annotations

from sleuthflow.llm.secrets import RULES, Rule
from sleuthflow.llm.sharding import BITS, Shard, full_tree, grown

TOP_PRODUCTS = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
        FROM embeddings
        WHERE len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
    )
    SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
    FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 20
"""


def _draw(level: str, child: int, weight: float) -> str:
    digits = f"substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/{level}{child}'), 1, {BITS // 4})"
    return f"-ln((('0x' || {digits})::BIGINT + 0.5::DOUBLE) / {float(1 << BITS):.1f}::DOUBLE) / {weight!r}::DOUBLE"


def _descent(members: list[Shard], levels: tuple[str, ...] = ("region", "rack", "shard")) -> str:
    """The child with the least draw at each level, as nested CASE."""
    if not levels:
        return str(members[0].shard)
    groups: dict[int, list[Shard]] = {}
    for s in members:
        groups.setdefault(getattr(s, levels[0]), []).append(s)
    if len(groups) == 1:
        return _descent(members, levels[1:])
    draws = {c: _draw(levels[0], c, sum(s.weight for s in ms)) for c, ms in groups.items()}
    least = f"least({', '.join(draws.values())})"
    return "CASE " + " ".join(f"WHEN {draws[c]} = {least} THEN {_descent(ms, levels[1:])}" for c, ms in groups.items()) + " END"


def shard_tree(shards: int = 8) -> str:
    """CRC-32 from a table made by its rule, byte by byte."""
    tree = full_tree(shards)
    return f"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda c: list_reduce([c] || range(8),
                lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS step
        ), d AS (
            SELECT doc_id, coalesce(text, '') AS body FROM documents
        ), placed AS (
            SELECT doc_id, (octet_length(encode(body)) + 1)::BIGINT AS size,
                xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT),
                    lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32,
                ({_descent(tree)})::INTEGER AS shard, ({_descent(grown(tree))})::INTEGER AS grown_shard
            FROM d, crc
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
            (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
        FROM placed
    """


def _pattern(rule: Rule) -> str:
    """The rule's pattern without flags; a run of one set takes its least length along."""
    pattern = rule.pattern
    if rule.either_case:
        head, rest = pattern.split(")", 1)
        pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + rest
    if rule.kind == "hex":
        pattern = pattern.removesuffix("+") + f"{{{rule.least},}}"
    return pattern.replace("'", "''")


def secret_spans() -> str:
    """Starts are the lengths of all pieces and matches before; texts are cut at the matches of each rule."""
    kinds = []
    for n, rule in enumerate(RULES):
        p = _pattern(rule)
        kinds.append(
            f"""SELECT doc_id, {n} AS k, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, p, {rule.least} AS least
            FROM (SELECT doc_id, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {rule.group}) AS g,
                regexp_split_to_array(body, '{p}') AS p FROM d)"""
        )
    base = sum(r.base for r in RULES)
    listed = "coalesce(string_agg(kind || ':' || low || ':' || stop, ',' ORDER BY low, k) {}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        found AS ({" UNION ALL ".join(kinds)}),
        spans AS (
            SELECT doc_id, k, kind, (list_sum(list_transform(p[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS low, length(m[i]) AS size
            FROM found WHERE length(g[i]) >= least
        ), whole AS (SELECT *, low + size AS stop FROM spans)
        SELECT d.doc_id, {counts}, sha256({listed.format(f'FILTER (k < {base})')}) AS base_sha256, {listed.format('FILTER (k IS NOT NULL)')} AS spans
        FROM d LEFT JOIN whole ON d.doc_id = whole.doc_id GROUP BY d.doc_id
    """


#: crc32 of UTF-8 bytes, from a table made by its rule, byte by byte.
CRC_STEPS = """list_transform(range(256), lambda c: list_reduce([c] || range(8),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def crc(text: str, steps: str = "step") -> str:
    return f"""xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda a, b: xor(a >> 8, {steps}[xor(a & 255, b) + 1])), 4294967295)::BIGINT"""


#: Cheapest edits by position and state, then the same edits once more to spell the repaired conversation.
CONVERSATIONS = f"""
    WITH RECURSIVE crc AS (SELECT {CRC_STEPS} AS step),
    marked AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations, crc
    ), kept AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM marked WHERE kind <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
        FROM kept
    ), faulty AS (
        SELECT *, left(role, 1) AS initial, CASE
            WHEN body = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ), turned AS (
        SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM faulty
    ), told AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated
        FROM faulty GROUP BY conv_id
    ), crossed AS (
        SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turned GROUP BY conv_id
    ), legal(state, role, following) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
    inserted AS (
        SELECT state, state AS here, '' AS edits, 0 AS cost FROM (VALUES (0), (1), (2), (3)) AS s(state)
        UNION ALL SELECT state, following, 'I', 5 FROM legal WHERE role <> 's'
        UNION ALL SELECT a.state, b.following, 'II', 10 FROM legal a JOIN legal b ON a.following = b.state WHERE a.role <> 's'
    ), ops AS (
        SELECT state, here AS following, edits || 'D' AS edits, cost + 2 AS cost, NULL AS initial, TRUE AS gone FROM inserted
        UNION ALL SELECT i.state, following, edits || 'K', cost, role, FALSE FROM inserted i JOIN legal l ON i.here = l.state
        UNION ALL SELECT i.state, following, edits || 'R', cost + 1, NULL, FALSE FROM inserted i JOIN legal l ON i.here = l.state WHERE role <> 's'
    ), paths(conv_id, pos, state, best) AS (
        SELECT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': ''}} FROM told
        UNION ALL
        SELECT p.conv_id, p.pos + 1, o.following,
            min({{'cost': p.best.cost + o.cost + CASE WHEN f.fault = 'truncated' AND NOT o.gone THEN 5 ELSE 0 END, 'audit': p.best.audit || o.edits}})
        FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1
        JOIN ops o ON o.state = p.state AND (o.initial IS NULL OR o.initial = f.initial) AND (o.gone OR f.fault NOT IN ('blank', 'duplicate'))
        GROUP BY p.conv_id, p.pos, o.following
    ), won AS (
        SELECT p.conv_id, min({{'cost': p.best.cost + i.cost, 'audit': p.best.audit || i.edits}}) AS best
        FROM paths p JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.pos
        JOIN inserted i ON i.state = p.state AND i.here IN (0, 3)
        GROUP BY p.conv_id
    ), spelled(conv_id, audit, k, pos, state, said) AS (
        SELECT conv_id, best.audit, 0::BIGINT, 0::BIGINT, 0, []::VARCHAR[] FROM won
        UNION ALL
        SELECT conv_id, audit, k + 1, pos + used, CASE WHEN who IS NULL THEN state WHEN left(who, 1) = 's' THEN 1 WHEN left(who, 1) = 'u' THEN 2 ELSE 3 END,
            CASE WHEN who IS NULL THEN said ELSE said || [who || ':' || what] END
        FROM (
            SELECT s.*, CASE WHEN edit = 'I' THEN 0 ELSE 1 END AS used, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS what,
                CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN f.role ELSE CASE WHEN s.state = 2 THEN 'assistant' ELSE 'user' END END AS who
            FROM (SELECT *, substr(audit, k + 1, 1) AS edit FROM spelled WHERE k < length(audit)) s
            LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos + 1
        )
    )
    SELECT o.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate,
        coalesce(t.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(w.best.cost, 0)::BIGINT AS cost,
        coalesce(w.best.audit, '') AS audit, sha256(coalesce(array_to_string(s.said, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN crossed c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN spelled s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.k = length(s.audit)
"""

CAP_LINKS = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS w
        FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
        WHERE list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)) >= 0.93
    ), reached(u, v) AS (
        SELECT u, v FROM links
        UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
    ), counted AS (SELECT u, count(*) AS n FROM links GROUP BY u),
    least AS (SELECT u, min(v) AS v FROM reached GROUP BY u)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(l.v, e.vec_id)) AS component_id,
        e.vec_id = least(e.vec_id, coalesce(l.v, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN counted c ON c.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
"""

ORACLES: dict[str, str] = {
    "op4_shard_tree": shard_tree(),
    "op9_secret_scan": secret_spans(),
    "op10_topk_segments": TOP_PRODUCTS,
    "op11_conversation_repair": CONVERSATIONS,
    "op12_cap_near_dedup": CAP_LINKS,
}
