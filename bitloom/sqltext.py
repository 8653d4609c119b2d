"""SQL texts for the oracle: the engine's steps said again over plain tables."""

from __future__ import annotations


def normalized(table: str, row: str, columns: dict[str, str]) -> str:
    """CTEs src, st, norm, w, offs and bits for a table; ``columns`` maps names to integer expressions.

    ``bits`` has a row per bit: f, local_bit, bit, ones, n.
    """
    names = list(columns)
    width = "CASE WHEN r{0} < 256 THEN 8 WHEN r{0} < 65536 THEN 16 WHEN r{0} < 4294967296 THEN 32 ELSE 64 END"
    src = ", ".join(f"CAST({e} AS BIGINT) AS c{i}" for i, e in enumerate(columns.values()))
    st = ", ".join(f"min(c{i}) AS m{i}, max(c{i}) - min(c{i}) AS r{i}" for i in range(len(names)))
    norm = ", ".join(f"c{i} - m{i} AS c{i}" for i in range(len(names)))
    w = ", ".join(f"{width.format(i)} AS w{i}" for i in range(len(names)))
    offs = ", ".join(f"{' + '.join(['0', *(f'w{j}' for j in range(i))])} AS o{i}" for i in range(len(names)))
    bits = " UNION ALL ".join(
        f"SELECT {i} AS f, '{n}' AS feature, b AS local_bit, o{i} + b AS bit, CAST(sum((c{i} >> b) & 1) AS BIGINT) AS ones, count(*) AS n FROM norm, offs, range(64) t(b) WHERE b < w{i} GROUP BY b, o{i}" for i, n in enumerate(names)
    )
    return f"src AS (SELECT {row} AS row_idx, {src} FROM {table}), st AS (SELECT {st} FROM src), norm AS (SELECT row_idx, {norm} FROM src, st), w AS (SELECT {w} FROM st), offs AS (SELECT *, {offs} FROM w), bits AS ({bits}), ranked AS (SELECT *, row_number() OVER (ORDER BY least(ones, n - ones), bit) AS rank FROM bits)"


def entropy(ones: str = "ones", n: str = "n") -> str:
    p = f"({ones}::DOUBLE / {n})"
    return f"CASE WHEN {ones} IN (0, {n}) THEN 0.0 ELSE -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) END"


def curve(columns: int) -> str:
    """CTEs keys and curve(k, n_b): distinct prefixes of each row's bits in rank order."""
    value = "CASE f " + " ".join(f"WHEN {i} THEN c{i}" for i in range(columns)) + " END"
    return f"keys AS (SELECT DISTINCT key FROM (SELECT row_idx, string_agg(CAST(({value} >> local_bit) & 1 AS VARCHAR), '' ORDER BY rank) AS key FROM norm, ranked GROUP BY row_idx)), curve AS (SELECT k, count(DISTINCT left(key, k)) AS n_b FROM keys, range(0, (SELECT count(*) + 1 FROM bits)) t(k) GROUP BY k)"


def sizes(columns: int) -> str:
    """CTE sizes over the curve."""
    ident = "CASE WHEN n_b <= 2 THEN 1 ELSE CAST(ceil(log2(n_b)) AS BIGINT) END"
    return f"dim AS (SELECT count(*) AS chunk, max(n) AS n, count_if(ones IN (0, n)) AS constants FROM bits), sizes AS (SELECT k, n_b, n_b * k AS size_bases, n * (chunk - k) AS size_deviations, n * {ident} AS size_ids, 16 * {columns} + 16 + chunk AS size_params, n_b * k + n * (chunk - k) + n * {ident} + 16 * {columns} + 16 + chunk AS total_size FROM curve, dim)"


def greedy_walk(start: str, patience: int) -> str:
    """CTEs marked (sizes from ``start`` on, a scalar subquery) and ended (where patience ends)."""
    return f"""walk AS (SELECT s.*, min(total_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sizes s WHERE k >= {start}),
marked AS (SELECT *, coalesce(max(CASE WHEN total_size < before THEN k END) OVER (ORDER BY k), {start}) AS last_better FROM walk),
ended AS (SELECT coalesce(min(k), (SELECT max(k) FROM marked)) AS stop FROM marked WHERE k - last_better >= {patience} AND k > {start})"""


def greedy(start: str, patience: int) -> str:
    """The selector's answer: k, n_b and size of the best prefix before patience ends."""
    return f"{greedy_walk(start, patience)} SELECT CAST(k AS INTEGER) AS k, CAST(n_b AS BIGINT) AS n_b, CAST(total_size AS BIGINT) AS total_size FROM marked, ended WHERE k <= stop ORDER BY total_size, k LIMIT 1"


def clusters(decay: float) -> str:
    """CTEs ent, nc and clus: the prefixes that cluster after cluster commits to (recursive)."""
    return (
        f"ent AS (SELECT rank AS k, {entropy()} AS e FROM ranked), nc AS (SELECT min(e) AS lo, max(e) AS hi FROM ent WHERE k > (SELECT constants FROM dim)), "
        f"clus AS (SELECT constants AS pos, (SELECT (hi - lo) * {decay} FROM nc) AS width, (SELECT total_size FROM sizes WHERE k = constants) AS best FROM dim UNION ALL SELECT nxt, width * {decay}, sz FROM "
        "(SELECT c.width, c.best, x.nxt, s.total_size AS sz FROM clus c, LATERAL (SELECT max(b.k) AS nxt FROM ent a, ent b WHERE a.k = c.pos + 1 AND b.k > c.pos AND b.e - a.e <= c.width) x JOIN sizes s ON s.k = x.nxt) WHERE sz < best)"
    )


def masks(columns: int, k: int) -> str:
    """CTE masks: per column the mask of the first ``k`` bits in rank order, and of the others."""
    parts = ", ".join(f"CAST(coalesce(sum(CASE WHEN f = {i} AND rank <= {k} THEN (1::BIGINT << local_bit) END), 0) AS BIGINT) AS m{i}, CAST(coalesce(sum(CASE WHEN f = {i} AND rank > {k} THEN (1::BIGINT << local_bit) END), 0) AS BIGINT) AS d{i}" for i in range(columns))
    return f"masks AS (SELECT {parts} FROM ranked)"


def based(columns: int) -> str:
    """CTE based: row_idx, base columns b<i>, deviations v<i>, and the base's id by first occurrence."""
    b = ", ".join(f"c{i} & m{i} AS b{i}, c{i} & d{i} AS v{i}" for i in range(columns))
    keys = ", ".join(f"b{i}" for i in range(columns))
    return f"split AS (SELECT row_idx, {b} FROM norm, masks), firsts AS (SELECT *, min(row_idx) OVER (PARTITION BY {keys}) AS first_row FROM split), based AS (SELECT *, dense_rank() OVER (ORDER BY first_row) - 1 AS base_id FROM firsts)"
