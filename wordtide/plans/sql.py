"""DuckDB statements of the drift queries, in parts that can be combined."""

from __future__ import annotations

from ..functions import expressions as ex
from .settings import DEFAULT, T_95, T_BEYOND, Settings

PIPELINE = """pipe AS (SELECT * FROM pipeline WHERE book_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id
  ORDER BY updated_at DESC NULLS LAST, s3_prefix_models DESC NULLS LAST, title DESC NULLS LAST, author DESC NULLS LAST) = 1)"""
TERMS = """bt AS (SELECT * FROM book_terms WHERE book_id IS NOT NULL AND term IS NOT NULL AND count_ IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY book_id, term ORDER BY published_at DESC NULLS LAST, count_ DESC) = 1)"""
NOT_ADVERB = "coalesce(NOT (list_distinct(tags) = ['R']), true)"
SENTENCES = """sent AS (SELECT * FROM token_lemmas WHERE lemmas IS NOT NULL AND s3_token_lemmas_key IS NOT NULL AND sent_ix IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s3_token_lemmas_key, sent_ix ORDER BY loaded_at DESC NULLS LAST, lemmas DESC NULLS LAST, tags DESC NULLS LAST) = 1)"""

def books(size: int = 16) -> str:
    """CTEs raw, cut and nv: the embeddings as books of four seeds of `size` dimensions."""
    return f"""raw AS (SELECT 'gutenberg-' || (vec_id % 5 + 1) AS book_id, printf('t%04d', vec_id // 5) AS term, vec_id % 90 + 10 AS count_,
  CASE WHEN vec_id % 17 = 0 THEN ['R'] ELSE ['N'] END AS tags, embedding::DOUBLE[] AS e FROM embeddings),
cut AS (SELECT book_id, term, i::INT AS seed_ix,
  list_transform(range(i * {size}, i * {size} + {size}), lambda j: CASE WHEN j % 2 = 0 THEN e[j % len(e) + 1] ELSE e[j % len(e) + 1] * (j // len(e) + 1) END) AS w
  FROM raw, (SELECT unnest(range(4)) AS i)),
nv AS (SELECT book_id, term, seed_ix, list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS v FROM cut)"""


BOOKS = books()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def query(trees: dict[str, ex.Tree]) -> str:
    """CTE q(expr, leaves, book_id, seed_ix, qv); every operator is a step of its own, brought to length 1."""
    parts, unions, n = [], [], 0
    for k, (expr, tree) in enumerate(trees.items()):
        own = ex.leaves(tree)
        columns = {t: f"l{i}" for i, t in enumerate(own)}
        held = ", ".join(f"max(CASE WHEN term = {text(t)} THEN v END) AS {c}" for t, c in columns.items())
        kept = " AND ".join(f"{c} IS NOT NULL" for c in columns.values())
        last = f"h{k}"
        parts.append(f"{last} AS (SELECT * FROM (SELECT book_id, seed_ix, {held} FROM nv GROUP BY book_id, seed_ix) WHERE {kept})")

        def step(node: ex.Tree) -> str:
            nonlocal n, last
            if isinstance(node, ex.Term):
                return columns[node.term]
            a, b = step(node.left), step(node.right)
            n += 1
            parts.append(f"s{n} AS (SELECT *, list_transform(range(1, len({a}) + 1), lambda i: {a}[i] {node.op} {b}[i]) AS r{n} FROM {last})")
            parts.append(f"u{n} AS (SELECT *, list_transform(r{n}, lambda x: x / greatest(sqrt(list_dot_product(r{n}, r{n})), 1e-12)) AS e{n} FROM s{n})")
            last = f"u{n}"
            return f"e{n}"

        result = step(tree)
        unions.append(f"SELECT {text(expr)} AS expr, {strings(own)} AS leaves, book_id, seed_ix, {result} AS qv FROM {last}")
    return ",\n".join(parts) + ",\nq AS (" + " UNION ALL ".join(unions) + ")"


def similar(q: str = "q", sim: str = "sim", msim: str = "msim", books: str = "") -> str:
    return f"""{sim} AS (SELECT expr, nv.book_id, nv.seed_ix, term, list_dot_product(v, qv) AS s FROM nv JOIN {q} USING (book_id, seed_ix)
  WHERE NOT list_contains(leaves, term){books}),
{msim} AS (SELECT expr, book_id, term, avg(s) AS m FROM {sim} GROUP BY ALL)"""


def centred(settings: Settings = DEFAULT, msim: str = "msim") -> str:
    return f"""ranks AS (SELECT *, rank() OVER (PARTITION BY expr, book_id ORDER BY m DESC) AS rank_,
  row_number() OVER (PARTITION BY expr, book_id ORDER BY m DESC, term) AS place FROM {msim}),
pos AS (SELECT *, m - avg(CASE WHEN place <= {settings.centre} THEN m END) OVER (PARTITION BY expr, book_id) AS position,
  rank_ <= {settings.stable_rank} AS in_stable, rank_ <= {settings.unstable_rank} AS in_unstable FROM ranks),
st AS (SELECT term, count(*) AS n_books_in, sum(in_stable::INT)::BIGINT AS n_books_as_top50, sum(in_unstable::INT)::BIGINT AS n_books_as_top100,
  avg(position) AS stability, coalesce(var_samp(position), 0) AS instability FROM pos GROUP BY term)"""


def comparative(settings: Settings = DEFAULT, selected: str | None = None) -> str:
    own = f" AND term IN (SELECT term FROM nv WHERE book_id = {text(selected)})" if selected else ""
    s = settings
    return f"""fit AS (SELECT * FROM st WHERE n_books_in >= {s.min_books}{own}),
stable AS (SELECT * FROM fit WHERE n_books_as_top50 >= {s.min_books_ranked} ORDER BY stability DESC, term LIMIT {s.comparative}),
pool AS (SELECT * FROM fit WHERE n_books_as_top100 >= {s.min_books_ranked} AND n_books_as_top50 >= {s.min_unstable_top50} ORDER BY stability DESC, term LIMIT {s.pool}),
unstable AS (SELECT * FROM pool ORDER BY instability DESC, term LIMIT {s.comparative}),
comp AS (SELECT * FROM stable UNION SELECT * FROM unstable)"""


def anchors(settings: Settings = DEFAULT, selected: str | None = None, msim: str = "msim") -> str:
    pinned = f" AND b.book_id = {text(selected)} AND a.book_id <> {text(selected)}" if selected else ""
    return f"""pairs AS (SELECT a.expr, a.book_id AS a, b.book_id AS b, a.term, count(*) OVER (PARTITION BY a.expr, a.book_id, b.book_id) AS shared,
  row_number() OVER (PARTITION BY a.expr, a.book_id, b.book_id ORDER BY a.m DESC, a.term) AS place
  FROM {msim} a JOIN {msim} b ON a.expr = b.expr AND a.term = b.term AND a.book_id <> b.book_id{pinned}),
anch AS (SELECT expr, a, b, term, place FROM pairs WHERE place <= {settings.anchors} AND shared >= {settings.anchors})"""


def local(sim: str = "sim") -> str:
    return f"""loc AS (SELECT anch.expr, anch.a, anch.b, x.seed_ix,
  covar_pop(x.s, y.s) * count(*) / greatest(sqrt(var_pop(x.s) * var_pop(y.s)) * count(*), 1e-12) AS c
  FROM anch JOIN {sim} x ON x.expr = anch.expr AND x.book_id = anch.a AND x.term = anch.term
  JOIN {sim} y ON y.expr = anch.expr AND y.book_id = anch.b AND y.term = anch.term AND y.seed_ix = x.seed_ix GROUP BY ALL)"""


def scored(pinned: bool) -> str:
    t = f"[{', '.join(map(str, T_95))}]"
    width = f"coalesce(CASE WHEN n > 1 THEN (CASE WHEN n - 1 > {len(T_95) - 1} THEN {T_BEYOND} ELSE ({t})[least(n - 1, {len(T_95) - 1})::INT + 1] END) * sd / sqrt(n) END, 0)"
    chosen = "ws.w" if pinned else "CASE WHEN n_books > 1 THEN wp.w ELSE ws.w END"
    return f"""seeds AS (SELECT book_id, (max(seed_ix) + 1)::INT AS n_seeds FROM nv GROUP BY book_id),
fewest AS (SELECT * FROM (SELECT loc.*, min(least(sa.n_seeds, sb.n_seeds)) OVER (PARTITION BY expr, a) AS n_seeds
  FROM loc JOIN seeds sa ON sa.book_id = a JOIN seeds sb ON sb.book_id = b) WHERE seed_ix < n_seeds),
whole AS (SELECT expr, a, avg(c) AS mean, count(DISTINCT b) AS n_books, max(n_seeds) AS n_seeds FROM fewest GROUP BY ALL),
ws AS (SELECT expr, a, {width} AS w FROM (SELECT expr, a, count(*) AS n, stddev_samp(c) AS sd FROM (SELECT expr, a, seed_ix, avg(c) AS c FROM fewest GROUP BY ALL) GROUP BY ALL)),
wp AS (SELECT expr, a, {width} AS w FROM (SELECT expr, a, count(*) AS n, stddev_samp(c) AS sd FROM (SELECT expr, a, b, avg(c) AS c FROM fewest GROUP BY ALL) GROUP BY ALL)),
score AS (SELECT whole.expr, whole.a AS book_id, mean, {chosen} AS width, n_seeds, n_books FROM whole JOIN ws USING (expr, a) JOIN wp USING (expr, a))"""


def score_columns() -> str:
    return "round(mean, 6) + 0.0 AS mean_local_similarity, round(mean - width, 6) + 0.0 AS ci_lo, round(mean + width, 6) + 0.0 AS ci_hi, n_seeds, n_books"
