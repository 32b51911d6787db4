"""DuckDB statements for those queries that SQL can express."""

from __future__ import annotations

from .norm import transducer

_CURRENT = """cur AS (SELECT book_id, term, count_ FROM (SELECT book_id, term, count_,
  row_number() OVER (PARTITION BY book_id, term ORDER BY published_at DESC NULLS LAST, count_ DESC) AS r
  FROM book_terms WHERE count_ IS NOT NULL AND book_id IS NOT NULL AND term IS NOT NULL) WHERE r = 1)"""

_MEMBERS = """members AS (SELECT DISTINCT term, book FROM (SELECT term, unnest(book_ids) AS book FROM corpus_terms)
  WHERE term IS NOT NULL AND book IS NOT NULL)"""

_P1 = f"""WITH {_CURRENT}, tf AS (SELECT book_id, term, greatest(count_, 0) AS tf FROM cur),
t AS (SELECT term, count(*) AS n_books, sum(tf) AS all_tf FROM tf GROUP BY term),
b AS (SELECT book_id, sum(tf) AS length FROM tf GROUP BY book_id),
w AS (SELECT count(*) AS n, sum(length) AS total FROM b),
x AS (SELECT tf.*, n_books, w.n, all_tf::DOUBLE / w.n AS rate,
  tf * log2(1 + (w.total::DOUBLE / w.n) / greatest(length, 1)) AS tfn FROM tf JOIN t USING (term) JOIN b USING (book_id), w)"""

_P4 = f"""WITH {_CURRENT}, {_MEMBERS}, books AS (SELECT count(DISTINCT book_id) AS total FROM cur),
x AS (SELECT term, coalesce(o, 0)::BIGINT AS occurrences, coalesce(k, 0) AS books
  FROM (SELECT DISTINCT term FROM corpus_terms WHERE term IS NOT NULL)
  LEFT JOIN (SELECT term, count(*) AS k FROM members GROUP BY term) USING (term)
  LEFT JOIN (SELECT term, sum(count_) AS o FROM cur GROUP BY term) USING (term))
SELECT term, occurrences, books, CASE WHEN books > total * 0.5 THEN 'common' WHEN books < 3 OR occurrences < 60 THEN 'rare' END AS mark
FROM x, books"""

_P7 = """WITH s AS (SELECT row_number() OVER () AS id, lemmas FROM (SELECT lemmas,
  row_number() OVER (PARTITION BY s3_token_lemmas_key, sent_ix ORDER BY loaded_at DESC NULLS LAST) AS r
  FROM token_lemmas WHERE lemmas IS NOT NULL AND s3_token_lemmas_key IS NOT NULL AND sent_ix IS NOT NULL) WHERE r = 1),
total AS (SELECT count(*)::DOUBLE AS n FROM s),
w AS (SELECT DISTINCT id, lemma FROM (SELECT id, unnest(lemmas) AS lemma FROM s) WHERE lemma <> ''),
f AS (SELECT lemma, count(*) AS c FROM w GROUP BY lemma),
p AS (SELECT a.lemma AS a, b.lemma AS b, count(*) AS n_ab FROM w a JOIN w b ON a.id = b.id AND a.lemma < b.lemma GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT a, b, fa.c AS n_a, fb.c AS n_b, n_ab, n, n_ab * n / (fa.c::DOUBLE * fb.c) AS lift,
  n_ab::DOUBLE AS k11, (fa.c - n_ab)::DOUBLE AS k12, (fb.c - n_ab)::DOUBLE AS k21, n - fa.c - fb.c + n_ab AS k22
  FROM p JOIN f fa ON fa.lemma = a JOIN f fb ON fb.lemma = b, total)"""


def _form(text: str) -> str:
    """SQL for the form for comparing: the mapping of single characters, then composed characters, without contexts."""
    table = transducer(True).table
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    single = {c: to for c, to in table.items() if len(to) == 1}
    out = f"translate({text}, {quote(''.join(single))}, {quote(''.join(single.values()))})"
    gone = "".join(f"\\x{{{ord(c):x}}}" for c, to in table.items() if not to)
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0e-\\x1f\\x7f{gone}]', '', 'g')"
    for c, to in table.items():
        if len(to) > 1 and to.isascii():
            out = f"replace({out}, {quote(c)}, {quote(to)})"
    return f"nfc_normalize({out})"


def _windows(name: str, table: str, key: str) -> str:
    words = f"regexp_extract_all(lower({_form('text')}), '(?:[\\p{{L}}\\p{{N}}][\\x{{300}}-\\x{{36f}}]*)+')"
    return f"""{name}w AS (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS words FROM {name}w WHERE len(w) >= 13)"""


def _xlogx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x}) * ln(greatest({x}, 1e-9)) ELSE 0 END)"


_LLR = "2 * (" + " + ".join(map(_xlogx, ("k11", "k12", "k21", "k22"))) + " - (" + " + ".join(map(_xlogx, ("n_a::DOUBLE", "n - n_a", "n_b::DOUBLE", "n - n_b"))) + f") + {_xlogx('n')})"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_scores": f"""{_P1} SELECT book_id, term, tf, n_books, round(CASE WHEN tf > 0 THEN
            (log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1) ELSE 0 END, 6) AS dfr FROM x""",
        "p1_found": f"""{_P1}, s AS (SELECT book_id, term, tf * ln(n::DOUBLE / n_books) AS score FROM x),
            r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, term) AS place FROM s)
            SELECT a.book_id, a.term FROM r a JOIN r b ON a.book_id = b.book_id AND a.place = 1 AND b.place = 2
            WHERE a.score > b.score AND a.score >= 1.57 * b.score""",
        "p4_frequencies": _P4,
        "p4_found": f"SELECT term, mark FROM ({_P4}) WHERE mark IS NOT NULL",
        "p6_found": f"""WITH {_MEMBERS}, sizes AS (SELECT term, count(*) AS n FROM members GROUP BY term HAVING count(*) >= 6),
            m AS (SELECT members.*, n FROM members JOIN sizes USING (term))
            SELECT a.term AS term_a, b.term AS term_b FROM m a JOIN m b ON a.book = b.book AND a.term < b.term
            GROUP BY a.term, b.term, a.n, b.n HAVING count(*) * 4 >= 3 * (a.n + b.n - count(*))""",
        # exact as long as two sets together fit a sketch of 256, as they do in the tables that this is run on
        "p6_estimates": f"""WITH {_MEMBERS}, sets AS (SELECT term, count(*) AS n, string_agg(book, ',' ORDER BY book) AS s FROM members GROUP BY term HAVING count(*) >= 6),
            m AS (SELECT of.term, n, book FROM (SELECT min(term) AS term, n FROM sets GROUP BY s, n) of JOIN members ON members.term = of.term),
            p AS (SELECT a.term AS term_a, b.term AS term_b, a.n AS n_a, b.n AS n_b, count(*)::DOUBLE AS shared FROM m a JOIN m b ON a.book = b.book
              AND (a.n > b.n OR (a.n = b.n AND a.term < b.term)) GROUP BY ALL)
            SELECT term_a, term_b, n_a, n_b, shared, round(shared / (n_a + n_b - shared), 6) AS share FROM p WHERE shared * 4 >= 3 * (n_a + n_b - shared)""",
        "p2_found": f"""WITH t AS (SELECT DISTINCT 'term' AS kind, book_id, term AS key, term AS raw FROM book_terms WHERE term IS NOT NULL AND book_id IS NOT NULL
            UNION ALL SELECT DISTINCT 'text', book_id, doc_id::VARCHAR, text FROM documents WHERE text IS NOT NULL AND book_id IS NOT NULL AND doc_id IS NOT NULL),
            f AS (SELECT kind, book_id, key, raw, CASE kind WHEN 'term' THEN regexp_replace({_form("raw")}, '^\\s+|\\s+$', '', 'g') ELSE {_form("raw")} END AS form FROM t)
            SELECT a.kind, a.book_id, a.key AS key_a, b.key AS key_b FROM f a JOIN f b USING (kind, book_id, form) WHERE a.key < b.key AND a.raw <> b.raw""",
        "p9_found": f"""WITH {_windows("d", "documents", "doc_id")}, {_windows("i", "eval_items", "item_id")}
            SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (words)""",
        "p7_pairs": f"""{_P7} SELECT a AS item_a, b AS item_b, n_a, n_b, n_ab, round(lift, 4) AS lift, round(greatest({_LLR}, 0), 3) AS llr
            FROM x WHERE {_LLR} >= 10.83""",
        "p7_found": f"{_P7} SELECT a AS lemma_a, b AS lemma_b FROM x WHERE lift >= 6",
    }
