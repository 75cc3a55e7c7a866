"""SQL equivalents of the queries that write files and read them again: what comes back is what the tables hold."""

from __future__ import annotations

from lapidary.plans.sql import FREQ, RUNS, chars, group_split, words


def plain(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def of(corpus: str, field: str) -> str:
    """CTE ``x``: values of a field of a corpus that are not blank, in order."""
    return f"""
      x AS (SELECT ord AS o, row_number() OVER (ORDER BY ord) - 1 AS ord, ord // 1000 AS part, coalesce(nullif({plain("doc_id")}, ''), 'none') AS doc, {plain(f"fields['{field}']")} AS t, fields, meta
            FROM records WHERE corpus = '{corpus}' AND coalesce({plain(f"fields['{field}']")}, '') <> '')"""


_SCHEMES = " UNION ALL ".join(
    f"SELECT '{name}' AS scheme, part, count(*) AS n FROM (WITH {group_split('y', group, label)} SELECT part FROM y JOIN _g ON {group} IS NOT DISTINCT FROM grp) GROUP BY ALL"
    for name, group, label in (("document_heldout", "doc_id", "document"), ("period_heldout", "century", "period"))
)
TERMINAL = "status IN ('completed', 'failed', 'abandoned')"

SQL: dict[str, str] = {
    "a3_conllu": f"""
      WITH {of("coptic_scriptorium", "text")} SELECT CAST(o AS VARCHAR) AS sent_id, doc AS doc_id, t AS text, nullif({plain("fields['translation_en']")}, '') AS english, 'sahidic' AS dialect, ord FROM x""",
    "a4_osis": f"WITH {of('hebrew_morphhb', 'text')} SELECT 'B' || part || '.' || o AS sent_id, 'B' || part AS doc_id, t AS text, ord FROM x",
    "a5_tei": rf"""
      WITH {of("greek_first1k", "text")}, y AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o) - 1 AS k, row_number() OVER (ORDER BY o) - 1 AS n FROM x
        WHERE len(string_split(t, ' ')) >= 3 AND regexp_matches(nfc_normalize(t), '[\x{{370}}-\x{{3ff}}\x{{1f00}}-\x{{1fff}}]'))
      SELECT printf('tlg0001.tlg001.f%08d.grc1.%05d', part, k) AS sent_id, 'tlg0001.tlg001' AS doc_id, nfc_normalize(t) AS text, n AS ord FROM y""",
    "a6_a7_tablets": f"""
      WITH {of("cuneiform_cdli", "text")}
      SELECT printf('P%06d', o) AS pnum, doc AS designation, CASE WHEN contains(t, ' ') THEN regexp_replace(t, ' ', ' / ') ELSE t END AS text,
             nullif(replace({plain("meta['language']")}, '"', ''''), '') AS language, nullif(replace({plain("meta['period']")}, '"', ''''), '') AS period FROM x""",
    "a8_word_pairs": f"""
      WITH x AS (SELECT ord, {plain("fields['src']")} AS a, {plain("fields['tgt']")} AS b FROM records WHERE fields['src'] IS NOT NULL AND fields['tgt'] IS NOT NULL)
      SELECT printf('cog-p%05d', row_number() OVER (ORDER BY ord) - 1) AS sent_id, a AS src, b AS tgt, 'a' AS name FROM x WHERE a || b <> ''""",
    "a9_plain_lines": f"WITH {of('meroitic_rem', 'text')} SELECT printf('rem.%05d', ord) AS sent_id, 'rem' AS doc_id, t AS text, ord FROM x",
    "a10_image_entries": f"""
      WITH e AS (SELECT ord, doc_id, {plain("fields['text']")} AS t, {plain("fields['translation_en']")} AS n, coalesce(nullif(trim(meta['period']), ''), 'unknown') AS date,
                        row_number() OVER (ORDER BY ord) - 1 AS i FROM records WHERE coalesce({plain("fields['text']")}, '') <> '' AND coalesce({plain("fields['translation_en']")}, '') <> ''),
      u AS (SELECT *, min(i) OVER (PARTITION BY date) AS f FROM e WHERE doc_id IS NOT NULL)
      SELECT printf('logogram_egy-d%03d', dense_rank() OVER (ORDER BY f)) AS doc_id, printf('logogram_egy-s%05d', i) AS sent_id, t AS text, n AS english, ord || '.png' AS image, date,
             (SELECT count(*) FROM e WHERE doc_id IS NULL) AS missing FROM u""",
    "a11_hosted_table": """
      WITH x AS (SELECT *, min(ord) OVER (PARTITION BY meta['dateNotBefore'], meta['dateNotAfter'], meta['authors']) AS f FROM records WHERE corpus = 'tla_demotic')
      SELECT ord, printf('tla-d%05d', dense_rank() OVER (ORDER BY f)) AS doc_id, printf('tla-s%06d', ord) AS sent_id, fields['translation_de'] AS german, fields['upos'] AS upos, 4 AS n_fields,
             meta['authors'] AS authors FROM x""",
    "a12_inventory": """
      WITH f AS (SELECT regexp_replace(lower(coalesce(source, 'none')), '[^a-z0-9]', '_', 'g') AS s, regexp_replace(lower(coalesce(domain, 'none')), '[^a-z0-9]', '_', 'g') AS e, count(*) AS n FROM documents GROUP BY 1, 2)
      SELECT s AS subset, count(*) OVER (PARTITION BY s) AS files, sum(n) OVER (PARTITION BY s)::BIGINT AS bytes, '.' || e AS ext, 1::BIGINT AS n FROM f""",
    "a16_training_logs": rf"""
      WITH {RUNS} SELECT run_id, run_id AS job, 1234::BIGINT AS params, coalesce(seed, 0) AS steps, 2.5::DOUBLE AS first_loss, 1.5::DOUBLE AS last_loss, CASE WHEN value IS NULL THEN 0.25 ELSE 0.5 END::DOUBLE AS best_eval
      FROM runs WHERE status = 'completed' AND regexp_full_match(run_id, '\S+')""",
    "a17_pattern_gate": """
      SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) WHERE regexp_matches(value, '[;:]') AND NOT contains(value, chr(13)) GROUP BY 1""",
    "j6_present_entries": """
      WITH x AS (SELECT doc_id, source, coalesce(source IN (SELECT source FROM mix_targets), false) AS there FROM documents)
      SELECT doc_id, source, (SELECT count(*) FROM x WHERE NOT there) AS missing FROM x WHERE there""",
    "j10_key_accuracy": f"""
      WITH {FREQ}, _p AS (SELECT fields['src'] AS s, fields['tgt'] AS t FROM records WHERE fields['src'] IS NOT NULL AND fields['tgt'] IS NOT NULL),
      _a AS (SELECT unnest({chars("s")}) AS ch FROM _p), _b AS (SELECT unnest({chars("t")}) AS ch FROM _p),
      a AS (SELECT ch AS src, row_number() OVER (ORDER BY (SELECT count(*) FROM _a WHERE _a.ch = _alpha.ch) DESC, pos) AS r FROM _alpha),
      b AS (SELECT ch AS tgt, row_number() OVER (ORDER BY (SELECT count(*) FROM _b WHERE _b.ch = _alpha.ch) DESC, pos) AS r FROM _alpha)
      SELECT round(avg((src = tgt)::INT), 9) AS accuracy FROM a JOIN b USING (r)""",
    "w7_first_rows": "SELECT sent_id, ord, row_number() OVER (ORDER BY sent_id, ord) - 1 AS place FROM records QUALIFY place < 100",
    "s7_schemes": rf"""
      WITH _y AS (SELECT ord, doc_id, TRY_CAST(nullif(regexp_extract(trim(meta['dateNotBefore']), '^[+-]?\d{{1,9}}$', 0), '') AS INT) AS y FROM records WHERE corpus = 'tla_demotic'),
      y AS (SELECT ord, doc_id, coalesce(CASE WHEN y IS NOT NULL THEN 'c' || CASE WHEN floor(y / 100) < 0 THEN '' ELSE '+' END || CAST(CAST(floor(y / 100) AS INT) AS VARCHAR) END, 'unknown') AS century FROM _y),
      r AS (SELECT row_number() OVER (ORDER BY sha256('1337|random|' || ord), ord) - 1 AS rank, count(*) OVER () AS n FROM y)
      SELECT 'random' AS scheme, CASE WHEN rank < round_even(n * CAST(0.8 AS DOUBLE), 0) THEN 'train'
        WHEN rank < round_even(n * CAST(0.8 AS DOUBLE), 0) + round_even(n * CAST(0.1 AS DOUBLE), 0) THEN 'valid' ELSE 'test' END AS part, count(*) AS n FROM r GROUP BY ALL UNION ALL {_SCHEMES}""",
    "l4_folded_events": f"""
      WITH {RUNS}, x AS (SELECT run_id, coalesce(registered_at, '') AS registered_at, coalesce(family, '') AS family, coalesce(phase, '') AS phase, CASE WHEN {TERMINAL} THEN status ELSE 'registered' END AS status,
        CASE WHEN {TERMINAL} THEN nullif(completed_at, '') END AS completed_at, coalesce(hypothesis, '') AS h, CASE WHEN {TERMINAL} THEN coalesce(notes, '') ELSE '' END AS n, coalesce(seed, 0) AS seed FROM runs WHERE run_id IS NOT NULL)
      SELECT run_id, registered_at, family, phase, status, completed_at, CASE WHEN h <> '' AND n <> '' THEN h || ' | ' || n ELSE h || n END AS notes, seed FROM x""",
    "l7_merged_lines": f"""
      WITH {RUNS} SELECT 'register' AS event, run_id FROM runs WHERE run_id IS NOT NULL UNION ALL SELECT 'complete', run_id FROM runs WHERE run_id IS NOT NULL AND {TERMINAL}""",
    "j14_missing_runs": f"WITH {RUNS} SELECT run_id, seed, config_hash FROM runs WHERE run_id IS NOT NULL AND status = 'completed' AND family IS NOT NULL",
    "b13_report_values": f"""
      WITH {RUNS}, v AS (SELECT family, row_number() OVER (PARTITION BY family ORDER BY value DESC) - 1 AS place, value FROM runs WHERE status = 'completed' AND value IS NOT NULL)
      SELECT family, place::INT AS place, round(value, 9) AS value FROM v WHERE place < 20""",
    "i1_store": f"WITH {group_split('records', 'doc_id', 'document')} SELECT part, count(*) AS n, 1::BIGINT AS logged, true AS intact FROM records JOIN _g ON doc_id IS NOT DISTINCT FROM grp GROUP BY 1",
}
