"""SQL equivalents, in DuckDB's dialect, of the queries SQL can express over whole tables.

Without an entry: those that need a tokenizer (p4, p9) or a seeded balance
(p1_split) or choose a spelling (p2_consistent).
"""

from __future__ import annotations

import unicodedata

from lapidary.llm import lookalike, splits
from lapidary.plans.sql_text import BLANK as _BLANK
from lapidary.plans.sql_text import bytewise, char_table, compatible, mapped, normal, normed

# fixed values: Unicode white space
BLANK = rf"[{_BLANK}]"

TERMS = rf"""
  v AS (SELECT ord, f AS field, fields[f] AS v FROM records, (SELECT unnest(['text', 'hieroglyphs']) AS f) WHERE fields[f] <> ''),
  t AS (SELECT ord, field, unnest(CASE WHEN field = 'text' THEN list_filter(regexp_split_to_array(v, '{BLANK}+'), lambda w: w <> '')
          ELSE list_concat(regexp_extract_all(v, '[\x{{13000}}-\x{{1345F}}]', 0), regexp_extract_all(v, '<g>([^<]+)</g>', 1)) END) AS term FROM v),
  n AS (SELECT field, count(*) AS total FROM v GROUP BY 1),
  c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT ord) AS records FROM t GROUP BY 1, 2),
  m AS (SELECT field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > total * CAST(0.1 AS DOUBLE) THEN 'common' END AS mark FROM c JOIN n USING (field))"""


def values(*fields: str) -> str:
    """CTE ``v(ord, field, v)`` of the values of some fields."""
    return f"v AS (SELECT ord, f AS field, fields[f] AS v FROM records, (SELECT unnest({list(fields)!r}) AS f) WHERE fields[f] <> '')"


def looks() -> str:
    """CTEs up to ``looks(ord, field, v)``: values with every look-alike letter replaced by the first of its class."""

    def plain(c: str) -> str:
        apart = unicodedata.normalize("NFD", c.translate(lookalike._plain))
        return "".join(next(iter(lookalike.CLASSES[lookalike.CLASS_OF[x]].values())) if x in lookalike.CLASS_OF else x for x in apart)

    return f"{char_table('_alike', plain)}, {mapped('looks', 'v', 'ord, field', '_alike')}"


# groups of records: documents by their folded id, tied by folded editors
_PUNCTUATION, _MORE = r"\p{P}\p{Z}\p{C}", r"\p{P}\p{S}\p{Z}\p{C}"
_FOLDED = "replace(replace(lower(v), 'ß', 'ss'), 'ς', 'σ')"
GROUPS = rf"""
  {compatible()},
  _i AS (SELECT DISTINCT doc_id AS id, doc_id AS v FROM records WHERE doc_id IS NOT NULL), {mapped("_im", "_i", "id", "_compat")},
  _ik AS (SELECT id, regexp_replace(regexp_replace({_FOLDED}, '[{_PUNCTUATION}{_BLANK}]', '', 'g'), '(^|\D)0+(\d)', '\1\2', 'g') AS dk FROM _im),
  _o AS (SELECT ord, corpus, doc_id, meta['authors'] AS authors, coalesce(dk, CASE WHEN doc_id IS NULL THEN '#' || ord ELSE '' END) AS dk FROM records LEFT JOIN _ik ON doc_id = id),
  _d AS (SELECT *, min(ord) OVER (PARTITION BY corpus, dk) AS node FROM _o),
  _x AS (SELECT DISTINCT trim(unnest(string_split(authors, ';'))) AS id FROM _d WHERE authors IS NOT NULL), _xv AS (SELECT id, id AS v FROM _x), {mapped("_xm", "_xv", "id", "_compat")},
  _xk AS (SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace({_FOLDED}, '[{_MORE}{_BLANK}]+', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') AS e FROM _xm),
  _t AS (SELECT DISTINCT node, e FROM (SELECT node, trim(unnest(string_split(authors, ';'))) AS id FROM _d WHERE authors IS NOT NULL) JOIN _xk USING (id)
         WHERE e NOT IN ({", ".join(f"'{x}'" for x in sorted(splits.NOBODY))})),
  _h AS (SELECT node, min(node) OVER (PARTITION BY e) AS hub FROM _t),
  _e AS (SELECT DISTINCT * FROM (SELECT node AS a, hub AS b FROM _h UNION ALL SELECT hub, node FROM _h) WHERE a <> b),
  _r AS (SELECT DISTINCT node AS a, node AS b FROM _d UNION SELECT _r.a, _e.b FROM _r JOIN _e ON _e.a = _r.b),
  _l AS (SELECT a AS node, min(b) AS label FROM _r GROUP BY 1),
  grouped AS (SELECT ord, corpus, doc_id, label FROM _d JOIN _l USING (node))"""

AFFECTED = f"""
  {values("translation_de", "text")}, {normed("q", "v", "ord, field")},
  _p AS (SELECT ord, min(part) AS part FROM split_parts WHERE scheme = 'random' AND tag = 'v1' AND part IS NOT NULL GROUP BY 1),
  _n AS (SELECT q.ord, field, n, corpus, part FROM q JOIN records USING (ord) JOIN _p USING (ord) WHERE n <> ''), {bytewise("_b", "_n", "corpus, field")},
  _s AS (SELECT corpus, field, n, length(n) AS l, translate(n, f, t) AS x, bool_or(part = 'train') AS tr, bool_or(part <> 'train') AS ev FROM _n JOIN _b USING (corpus, field) GROUP BY ALL),
  _f AS (SELECT DISTINCT e.corpus, e.field, e.n FROM _s e JOIN _s t ON e.corpus = t.corpus AND e.field = t.field AND e.ev AND t.tr AND abs(e.l - t.l) <= e.l // 10 WHERE levenshtein(e.x, t.x) <= e.l // 10),
  affected AS (SELECT DISTINCT field, ord, part, corpus FROM _n JOIN _f USING (corpus, field, n) WHERE part <> 'train')"""

SIMILAR = f"""
  {values("translation_de", "transliteration")}, {normed("q", "v", "ord, field")},
  _w AS (SELECT ord, field, list_sort(list_distinct(string_split(n, ' '))) AS w FROM q WHERE len(string_split(n, ' ')) >= 8),
  _k AS (SELECT field, w, min(ord) AS rep, len(w) AS size FROM _w GROUP BY 1, 2),
  _u AS (SELECT field, rep, size, unnest(w) AS word FROM _k),
  _c AS (SELECT a.field, a.rep AS a, b.rep AS b, a.size + b.size AS total, count(*) AS same FROM _u a JOIN _u b ON a.field = b.field AND a.word = b.word AND a.rep < b.rep GROUP BY ALL),
  links AS (SELECT field, a, b FROM _c WHERE 10 * same >= 7 * (total - same)),
  member AS (SELECT ord, field, rep FROM _w JOIN _k USING (field, w))"""

SHARED = """
  _w AS (SELECT doc_id, i, md5(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
  _h AS (SELECT h FROM _w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
  held AS (SELECT doc_id, i, h FROM _w JOIN _h USING (h))"""

STRETCHES = f"""{SHARED},
  _m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT DISTINCT doc_id, i FROM held)),
  _g AS (SELECT doc_id, i, sum((b IS NULL OR i > b + 300)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM _m),
  stretches AS (SELECT doc_id, (min(i) - 1)::INT AS start, (max(i) + 299)::INT AS "end" FROM _g GROUP BY doc_id, g)"""


def runs(table: str, key: str) -> str:
    """Runs of twelve words of a table's texts, as (key, run)."""
    return f"""
      _{table} AS (SELECT {key}, text AS v FROM {table} WHERE text <> ''), {mapped(f"_m{table}", f"_{table}", key, "_compat")},
      _s{table} AS (SELECT {key}, string_split({normal("v")}, ' ') AS w FROM _m{table}),
      r_{table} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM _s{table} WHERE len(w) >= 12))"""


LEAKS = f"{compatible()}, {runs('documents', 'doc_id')}, {runs('eval_items', 'item_id')}, leaks AS (SELECT DISTINCT doc_id, item_id FROM r_documents JOIN r_eval_items USING (run))"

SQL: dict[str, str] = {
    "p1_found": f"""
      WITH RECURSIVE {GROUPS}, many AS (SELECT label FROM (SELECT DISTINCT label, corpus, coalesce(doc_id, chr(1)) AS d FROM grouped) GROUP BY 1 HAVING count(*) > 1)
      SELECT DISTINCT ord, label AS group_ord FROM grouped JOIN many USING (label)""",
    "p2_found": f"""
      WITH {values(*lookalike.FIELDS)}, {looks()}, {normed("q", "v", "ord, field")},
      x AS (SELECT v.ord, v.field, v.v AS raw, looks.v AS form FROM v JOIN looks USING (ord, field) JOIN q USING (ord, field) WHERE n <> '')
      SELECT DISTINCT a.field, a.ord AS ord_a, b.ord AS ord_b FROM x a JOIN x b ON a.field = b.field AND a.form = b.form AND a.raw <> b.raw AND a.ord < b.ord""",
    "p3_found": f"WITH {AFFECTED} SELECT DISTINCT field, ord FROM affected",
    "p3_overlap_report": f"WITH {AFFECTED} SELECT part, corpus, field, count(DISTINCT ord) AS n_records FROM affected GROUP BY CUBE (part, corpus, field)",
    "p5_found": f"""
      WITH {SIMILAR}, p AS (SELECT field, a, b FROM links UNION ALL SELECT field, rep, rep FROM _k)
      SELECT DISTINCT p.field, least(x.ord, y.ord) AS ord_a, greatest(x.ord, y.ord) AS ord_b
      FROM p JOIN member x ON x.field = p.field AND x.rep = a JOIN member y ON y.field = p.field AND y.rep = b WHERE x.ord <> y.ord""",
    "p5_groups": f"""
      WITH RECURSIVE {SIMILAR}, _e AS (SELECT field, a, b FROM links UNION ALL SELECT field, b, a FROM links),
      _r AS (SELECT field, rep AS a, rep AS b FROM _k UNION SELECT _r.field, _r.a, _e.b FROM _r JOIN _e ON _e.field = _r.field AND _e.a = _r.b),
      _l AS (SELECT field, a AS rep, min(b) AS label FROM _r GROUP BY 1, 2), _n AS (SELECT field, a AS rep, count(*) AS n_links FROM _e GROUP BY 1, 2),
      x AS (SELECT field, ord, label, coalesce(n_links, 0) AS n_links, count(*) OVER (PARTITION BY field, rep) AS copies FROM member JOIN _l USING (field, rep) LEFT JOIN _n USING (field, rep))
      SELECT field, ord, label AS group_ord, n_links FROM x WHERE copies > 1 OR n_links > 0""",
    "p7_found": f"WITH {TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p7_term_frequencies": f"WITH {TERMS} SELECT field, term, occurrences, records, mark FROM m",
    "p8_found": f"WITH {LEAKS} SELECT doc_id, item_id FROM leaks",
    "p8_leak_report": f"""
      WITH {LEAKS} SELECT source, count(DISTINCT doc_id) AS n_documents, count(DISTINCT item_id) AS n_items FROM leaks JOIN documents USING (doc_id) GROUP BY 1""",
    "p10_found": f"WITH {SHARED} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_stretches": f'WITH {STRETCHES} SELECT doc_id, start, "end" FROM stretches',
    "p10_shared_share": f"""
      WITH {STRETCHES}, c AS (SELECT doc_id, count(*) AS n, sum("end" - start) AS c FROM stretches GROUP BY 1)
      SELECT doc_id, length(text)::INT AS n_chars, coalesce(n, 0) AS n_stretches, coalesce(c, 0)::BIGINT AS shared_chars, round(coalesce(c / length(text), 0.0), 6) AS share FROM documents LEFT JOIN c USING (doc_id)""",
}
