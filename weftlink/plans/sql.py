"""SQL counterparts of the registered queries: named steps, each a select over tables and earlier steps."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def md5_low(x: str) -> str:
    """The low 64 bits of md5 as hexadecimal text whose order is the number's."""
    return "(" + " || ".join(f"substr(md5({x}), {31 - 2 * k}, 2)" for k in range(8)) + ")"


def bucket(x: str, n: int) -> str:
    return f"CAST(md5_number_lower({x}) % {n} AS BIGINT)"


def fbeta(tp: str, p: str, t: str) -> str:
    return f"CASE WHEN {t} = 0 AND {p} = 0 THEN 1.0 WHEN {tp} = 0 THEN 0.0 ELSE 1.25 * {tp} / (1.25 * {tp} + 0.25 * ({t} - {tp}) + ({p} - {tp})) END::DOUBLE"


def _keys(ids: str, table: str) -> str:
    token = lambda f: f"SELECT {ids}, country, unnest(string_split({f}, ' ')) AS token FROM {table}"
    n, a = f"(SELECT * FROM ({token('name')}) WHERE length(token) >= 3)", f"(SELECT * FROM ({token('address')}) WHERE length(token) >= 3)"
    return f"""SELECT {ids}, country, key_type, key, max(key_weight) AS key_weight FROM (
        SELECT {ids}, country, 'name_exact' AS key_type, token AS key, 1.0::DOUBLE AS key_weight FROM {n}
        UNION ALL SELECT {ids}, country, 'name_prefix', left(token, 4), 0.65::DOUBLE FROM {n} WHERE length(token) >= 5
        UNION ALL SELECT {ids}, country, 'name_suffix', right(token, 4), 0.65::DOUBLE FROM {n} WHERE length(token) >= 5
        UNION ALL SELECT {ids}, country, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'address_number' ELSE 'address_exact' END,
            token, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 0.90 ELSE 0.45 END::DOUBLE FROM {a})
        GROUP BY ALL"""


PAIR = "source1_entity_id, candidate_entity_id, candidate_source"
KEY = "candidate_source, country, key_type, key"
#: name: (steps that it reads, select)
STEPS: dict[str, tuple[str, str]] = {
    "rec": ("", "SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 1 + doc_id % 3 AS src, left(text, 48) AS business_name, substr(text, 49) AS business_address, lang AS country FROM documents"),
    "q": ("rec", f"SELECT entity_id AS source1_entity_id, country, {norm('business_name')} AS name, {norm('business_address')} AS address FROM rec WHERE src = 1"),
    "t": ("rec", f"SELECT entity_id AS candidate_entity_id, 'source' || src AS candidate_source, country, {norm('business_name')} AS name, {norm('business_address')} AS address FROM rec WHERE src > 1"),
    "keyed": ("rec", f"SELECT * FROM (SELECT entity_id, src, country, {norm('left(business_name, 24)')} AS key FROM rec) WHERE key <> ''"),
    "pairs": ("keyed", "SELECT o.source1_entity_id, k.entity_id AS candidate_entity_id FROM keyed k JOIN (SELECT country, key, min(entity_id) AS source1_entity_id FROM keyed WHERE src = 1 GROUP BY ALL) o USING (country, key) WHERE k.src > 1"),
    "truth": ("q pairs", "SELECT source1_entity_id, coalesce(ids, '') AS matched_entity_ids, coalesce(n, 0) AS match_count FROM q LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id) AS ids, count(*) AS n FROM pairs GROUP BY ALL) USING (source1_entity_id)"),
    "exact": ("q t", f"""SELECT {PAIR}, max(exact_name) AS exact_name, max(exact_address) AS exact_address FROM (
        SELECT {PAIR}, 1 AS exact_name, 0 AS exact_address FROM q JOIN t ON q.country = t.country AND q.name = t.name WHERE q.name <> ''
        UNION ALL SELECT {PAIR}, 0, 1 FROM q JOIN t ON q.country = t.country AND q.address = t.address WHERE q.address <> '') GROUP BY ALL"""),
    "tkeys": ("t", _keys("candidate_entity_id, candidate_source", "t")),
    "qkeys": ("q", _keys("source1_entity_id", "q")),
    "freq": ("tkeys", f"SELECT {KEY}, count(*) AS document_frequency FROM tkeys GROUP BY ALL"),
    "pools": ("t", "SELECT candidate_source, country, count(*) AS target_count FROM t GROUP BY ALL"),
    "sel": ("qkeys freq pools", """SELECT source1_entity_id, candidate_source, country, key_type, key, key_weight, document_frequency, ln((target_count + 1.0::DOUBLE) / (document_frequency + 1.0::DOUBLE)) AS idf
        FROM qkeys JOIN freq USING (country, key_type, key) JOIN pools USING (candidate_source, country) WHERE document_frequency <= 200
        QUALIFY row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY document_frequency, key_weight DESC, key_type, key) <= 6"""),
    "fuzzy": ("sel tkeys", f"""SELECT * FROM (SELECT {PAIR}, round(sum(sel.key_weight * idf), 9) AS fuzzy_score, count(*) AS shared_blocking_keys FROM sel JOIN tkeys USING ({KEY}) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY fuzzy_score DESC, shared_blocking_keys DESC, candidate_entity_id) <= 50"""),
    "final": ("exact fuzzy", f"""SELECT {PAIR}, max(exact_name) AS exact_name, max(exact_address) AS exact_address, max(fuzzy_score) AS fuzzy_score, max(shared_blocking_keys) AS shared_blocking_keys FROM (
        SELECT {PAIR}, exact_name, exact_address, 0.0::DOUBLE AS fuzzy_score, 0 AS shared_blocking_keys FROM exact UNION ALL SELECT {PAIR}, 0, 0, fuzzy_score, shared_blocking_keys FROM fuzzy) GROUP BY ALL"""),
    "offered_by_rules": ("final", "SELECT *, 0.0::DOUBLE AS char_name_score FROM final"),
    "strong": ("offered_by_rules", "SELECT *, round(4.0::DOUBLE * exact_name + 4.0::DOUBLE * exact_address + 0.10::DOUBLE * ln(1.0::DOUBLE + greatest(fuzzy_score, 0.0)) + 2.0::DOUBLE * char_name_score + 0.01::DOUBLE * shared_blocking_keys, 9) AS block_strength FROM offered_by_rules"),
    "ranked": ("strong", """SELECT *, row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY block_strength DESC, candidate_entity_id) AS candidate_rank_source,
        count(*) OVER (PARTITION BY source1_entity_id) AS candidate_count, count(*) OVER (PARTITION BY source1_entity_id, candidate_source) AS source_candidate_count, max(char_name_score) OVER (PARTITION BY source1_entity_id) AS best_retrieval FROM strong"""),
    "scores": ("strong", f"SELECT {PAIR}, round(block_strength / (1.0::DOUBLE + block_strength), 9) AS score FROM strong"),
    "hits": ("scores pairs", "SELECT scores.*, pairs.candidate_entity_id AS hit FROM scores LEFT JOIN pairs USING (source1_entity_id, candidate_entity_id)"),
    "sample_ranked": ("ranked pairs", f"""SELECT *, row_number() OVER (g ORDER BY block_strength DESC, candidate_entity_id) AS by_strength,
        row_number() OVER (g ORDER BY {md5_low("candidate_entity_id || ':20260925:negative'")}, candidate_entity_id) AS by_chance, count_if(label = 0) OVER (PARTITION BY source1_entity_id, candidate_source) AS negatives
        FROM (SELECT ranked.*, CASE WHEN pairs.candidate_entity_id IS NULL THEN 0 ELSE 1 END AS label FROM ranked LEFT JOIN pairs USING (source1_entity_id, candidate_entity_id))
        WINDOW g AS (PARTITION BY source1_entity_id, candidate_source, label)"""),
    "attached": ("ranked q t", f"""SELECT r.*, q.name AS q_name, q.address AS q_address, q.country AS q_country, q_n, t.name AS t_name, t.address AS t_address, t.country AS t_country, t_n, t_a,
        {words('q.name')} AS qw, {words('t.name')} AS tw, {words('q.address')} AS qx, {words('t.address')} AS tx, regexp_extract_all(q.address, '[0-9]+') AS qd, regexp_extract_all(t.address, '[0-9]+') AS td
        FROM ranked r JOIN (SELECT *, count(*) OVER (PARTITION BY country, name) AS q_n FROM q) q USING (source1_entity_id)
        JOIN (SELECT *, count(*) OVER (PARTITION BY candidate_source, country, name) AS t_n, count(*) OVER (PARTITION BY candidate_source, country, address) AS t_a FROM t) t USING (candidate_entity_id, candidate_source)"""),
    "per_entity": ("q truth hits", f"""SELECT source1_entity_id, match_count AS true_count, coalesce(p, 0) AS predicted_count, coalesce(h, 0) AS true_positive, round({fbeta('coalesce(h, 0)', 'coalesce(p, 0)', 'match_count')}, 9) AS entity_f0_5
        FROM truth LEFT JOIN (SELECT source1_entity_id, count(*) AS p, count(hit) AS h FROM hits WHERE score >= 0.5 GROUP BY ALL) USING (source1_entity_id)"""),
    "per_entity_by_source": ("q truth hits", f"""SELECT source1_entity_id, match_count AS true_count, coalesce(p, 0) AS predicted_count, coalesce(h, 0) AS true_positive, round({fbeta('coalesce(h, 0)', 'coalesce(p, 0)', 'match_count')}, 9) AS entity_f0_5
        FROM truth LEFT JOIN (SELECT source1_entity_id, count(*) AS p, count(hit) AS h FROM hits WHERE (candidate_source = 'source2' AND score >= 0.45::DOUBLE) OR (candidate_source = 'source3' AND score >= 0.6::DOUBLE) GROUP BY ALL) USING (source1_entity_id)"""),
    "errors": ("pairs final scores", """SELECT p.source1_entity_id, p.candidate_entity_id, CASE WHEN starts_with(p.candidate_entity_id, 'S3-') THEN 'source3' ELSE 'source2' END AS candidate_source,
            CASE WHEN f.source1_entity_id IS NULL THEN 'blocking_false_negative' ELSE 'matcher_false_negative' END AS error_type, s.score
        FROM pairs p LEFT JOIN final f USING (source1_entity_id, candidate_entity_id) LEFT JOIN scores s USING (source1_entity_id, candidate_entity_id) WHERE NOT coalesce(s.score >= 0.5, false)
        UNION ALL SELECT s.source1_entity_id, s.candidate_entity_id, s.candidate_source, 'false_positive', s.score FROM scores s ANTI JOIN pairs p USING (source1_entity_id, candidate_entity_id) WHERE s.score >= 0.5"""),
    "assigned": ("q truth", """SELECT entity_id, country, match_count, CASE WHEN stratum_rank <= v THEN 'validation' WHEN stratum_rank <= v + l THEN 'local_test' ELSE 'train' END AS split FROM (
        SELECT *, CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.05::DOUBLE)) ELSE 0 END AS v, CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.05::DOUBLE)) ELSE 0 END AS l FROM (
        SELECT source1_entity_id AS entity_id, country, match_count, count(*) OVER s AS n, row_number() OVER (PARTITION BY country, match_count ORDER BY md5_number_lower('20260925:' || source1_entity_id)) AS stratum_rank
        FROM q JOIN truth USING (source1_entity_id) WINDOW s AS (PARTITION BY country, match_count)))"""),
    "owned": ("t pairs assigned", f"""SELECT t.candidate_entity_id AS entity_id, candidate_source AS source, t.country, p.source1_entity_id AS owner_source1_entity_id,
        coalesce(a.split, CASE WHEN {bucket("'20260925:unmatched:' || t.candidate_entity_id", 10000)} < 500 THEN 'validation' WHEN {bucket("'20260925:unmatched:' || t.candidate_entity_id", 10000)} < 1000 THEN 'local_test' ELSE 'train' END) AS split
        FROM t LEFT JOIN pairs p USING (candidate_entity_id) LEFT JOIN assigned a ON a.entity_id = p.source1_entity_id"""),
    "strata": ("q t truth pairs", """SELECT source1_entity_id AS entity_id, 'source1' AS source, coalesce(nullif(country, ''), '<missing-country>') || '|' || CASE WHEN match_count = 0 THEN 'singleton' ELSE 'matched' END AS stratum, 20260925 AS seed FROM q JOIN truth USING (source1_entity_id)
        UNION ALL SELECT candidate_entity_id, candidate_source, candidate_source || '|' || coalesce(nullif(country, ''), '<missing-country>') || '|unmatched', 20260926 FROM t ANTI JOIN pairs USING (candidate_entity_id)"""),
    "dealt": ("strata", "SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY sha256(seed || ':' || entity_id), entity_id) - 1) % 5 AS fold FROM strata"),
    "matched": ("truth scores", "SELECT source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM truth LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id) AS ids FROM scores WHERE score >= 0.5 GROUP BY ALL) USING (source1_entity_id)"),
    "offered": ("truth final", "SELECT source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM truth LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id) AS ids FROM final GROUP BY ALL) USING (source1_entity_id)"),
    "manifest": ("dealt pairs", """SELECT entity_id, source, CAST(fold AS BIGINT) AS fold, CASE WHEN source = 'source1' THEN entity_id ELSE 'unmatched:' || entity_id END AS entity_group FROM dealt
        UNION ALL SELECT p.candidate_entity_id, CASE WHEN starts_with(p.candidate_entity_id, 'S2-') THEN 'source2' ELSE 'source3' END, CAST(d.fold AS BIGINT), p.source1_entity_id FROM pairs p JOIN dealt d ON d.entity_id = p.source1_entity_id"""),
    "allrec": ("rec", "SELECT entity_id, 'source' || src AS source, business_name, business_address, country FROM rec"),
}


def sql(steps: str, select: str, other: dict[str, tuple[str, str]] | None = None) -> str:
    """A query with the named steps, and those that they read, as CTEs. other: steps that stand in for those named so."""
    known, need = STEPS | (other or {}), []

    def add(name: str) -> None:
        for n in known[name][0].split():
            add(n)
        if name not in need:
            need.append(name)

    for name in steps.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({known[n][1]})" for n in need) + f"\n{select}"
