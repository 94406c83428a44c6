"""The queries of this folder in SQL, where SQL can express them."""

from __future__ import annotations

from emberline.llm import conversation_repair, filter_audit, minhash_dedup, mixing, quality_rules, secret_scan, suffix_tree_dedup
from emberline.llm.queries import LISTED_HOSTS, URL_RULES

WORD = r"[^\x20\x09-\x0D]+"


def _texts(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def quality_sql() -> str:
    q = quality_rules
    ends, closers = _texts(sorted(q.SENTENCE_ENDS)), q.CLOSERS.replace("'", "''")
    separators = _texts(sorted(value.decode() for value in q.SEPARATORS))
    phrases = " OR ".join(f"contains(low, '{phrase}')" for phrase in q.PHRASES)
    window = ", ".join(f"lead(word, {i}) OVER seq AS w{i}" for i in range(1, q.WINDOW))
    whole = " || ' ' || ".join(["word"] + [f"w{i}" for i in range(1, q.WINDOW)])
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), word_rows AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
), windows AS (
  SELECT doc_id, pos, word, {window} FROM word_rows WINDOW seq AS (PARTITION BY doc_id ORDER BY pos)
), repeated AS (
  SELECT doc_id, pos FROM windows WHERE w{q.WINDOW - 1} IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, {whole}) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos + step) AS n FROM repeated, (SELECT unnest(range({q.WINDOW})) AS step) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '{WORD}') AS words, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS stripped
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
), facts AS (
  SELECT *, len(words) AS n, lower(stripped) AS low, length(array_to_string(words, '')) AS chars,
    right(rtrim(stripped, '{closers}'), 1) IN ({ends}) AS ended,
    len(list_filter(words, lambda w: w IN ({separators}))) AS separators,
    length(regexp_replace(stripped, '[^#*$%&|<>]', '', 'g')) AS symbols,
    len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS capitals
  FROM lines
), judged AS (
  SELECT *, n > 0 AND (
    100 * separators > {q.MAX_SEPARATOR_PCT} * n OR (NOT ended AND n <= {q.MENU_WORDS}) OR {phrases}
    OR 100 * symbols > {q.MAX_SYMBOL_PCT} * n OR (n > {q.MENU_WORDS} AND 100 * capitals > {q.MAX_CAPITAL_PCT} * n)
    OR (NOT ended AND (n < {q.LONG_LINE} OR NOT regexp_matches(stripped, '[.!?…][ \t]')))) AS failed
  FROM facts
), by_doc AS (
  SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(DISTINCT line) FILTER (n > 0) AS n_different,
    count(*) FILTER (failed) AS n_lines_removed, coalesce(sum(chars) FILTER (failed), 0) AS lost_chars
  FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    n_lines - n_different AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, n_lines, n_lines_removed, CAST(lost_chars AS BIGINT) AS lost_chars
  FROM docs d JOIN by_doc b ON d.doc_id = b.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words) AND lost_chars <= {q.MAX_LOST} * word_chars AS kept
FROM base
"""


CHAT_SQL = """
WITH last AS (
  SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id
), stale AS (
  SELECT c.conv_id, max(coalesce(text, '')) AS stale FROM conversations c JOIN last l ON c.conv_id = l.conv_id WHERE turn = last - 2 GROUP BY c.conv_id
), turns AS (
  SELECT c.conv_id, turn, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS good,
    replace(CASE WHEN turn = last THEN coalesce(stale, '') ELSE coalesce(text, '') END, '<|im_', '< |im_') AS bad
  FROM conversations c JOIN last l ON c.conv_id = l.conv_id LEFT JOIN stale s ON c.conv_id = s.conv_id
), split AS (
  SELECT conv_id, min(turn) FILTER (good <> bad) AS split FROM turns GROUP BY conv_id
), pieces AS (
  SELECT t.*, split IS NULL OR turn < split AS shared,
    '<|im_start|>' || role || chr(10) || good || '<|im_end|>' || chr(10) AS good_text,
    '<|im_start|>' || role || chr(10) || bad || '<|im_end|>' || chr(10) AS bad_text
  FROM turns t JOIN split s ON t.conv_id = s.conv_id
)
SELECT conv_id, count(*) FILTER (shared) AS prefix_turns,
  coalesce(string_agg(good_text, '' ORDER BY turn) FILTER (shared), '') AS prompt,
  coalesce(string_agg(good_text, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
  coalesce(string_agg(bad_text, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
  CAST(coalesce(sum(length(good) + 10) FILTER (NOT shared AND role = 'assistant'), 0) AS BIGINT) AS chosen_loss_chars,
  CAST(coalesce(sum(length(bad) + 10) FILTER (NOT shared AND role = 'assistant'), 0) AS BIGINT) AS rejected_loss_chars
FROM pieces GROUP BY conv_id
"""


def url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda rule: -len(rule[1] + rule[2]))
    fits = [
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
        for _, host, path in rules
    ]
    verdicts = [f"WHEN '{host}{path}' THEN '{kind}'" for kind, host, path in rules]
    listed = " OR ".join(f"host = '{host}' OR ends_with(host, '.{host}')" for host in LISTED_HOSTS)
    return rf"""
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS authority FROM rests
), parts AS (
  SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substring(rest, length(authority) + 1), '^[^?#]*') AS path
  FROM hosts
), ruled AS (
  SELECT *, CASE {' '.join(fits)} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE rule {' '.join(verdicts)} ELSE CASE WHEN {listed} THEN 'block' ELSE 'allow' END END AS verdict FROM ruled
"""


def mixing_sql() -> str:
    m = mixing
    weights = ", ".join(str(weight) for weight in m.WEIGHTS)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {float(m.CAP)} * sum(size) AS max_words,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), levels AS (
  SELECT *, ([{weights}])[(place - 1) % {len(m.WEIGHTS)} + 1]::DOUBLE AS weight, {m.SHARE} * sum(source_size) OVER () AS words FROM totals
), fills AS (
  SELECT *, sum(max_words) OVER upto + max_words / weight * (sum(weight) OVER () - sum(weight) OVER upto) <= words AS is_full
  FROM levels WINDOW upto AS (ORDER BY max_words / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN max_words ELSE least(max_words,
    (words - coalesce(sum(max_words) FILTER (is_full) OVER (), 0)) * weight / sum(weight) FILTER (NOT is_full) OVER ()) END AS target
  FROM fills
), wanted AS (
  SELECT s.*, t.source_size, t.target, coalesce(CASE WHEN t.source_size > 0 THEN least({float(m.CAP)}, t.target / t.source_size) END, 0) AS wanted,
    (CAST('0x' || substring(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {m.HEX_DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {float(16**m.HEX_DIGITS)!r} AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, CAST(floor(wanted) AS BIGINT) AS whole, CASE WHEN floor(wanted) < {m.CAP} THEN size ELSE 0 END AS spare,
    CASE WHEN wanted > floor(wanted) THEN (u / (1 - u)) / ((wanted - floor(wanted)) / (1 - (wanted - floor(wanted)))) END AS odds
  FROM wanted
), counted AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS open, coalesce(sum(spare) OVER (PARTITION BY source
    ORDER BY odds NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed
), copied AS (
  SELECT *, whole + CASE WHEN spare > 0 AND before + spare / 2.0 <= open THEN 1 ELSE 0 END AS copies FROM counted
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM copied
"""


def near_duplicate_sql() -> str:
    m = minhash_dedup
    shingle = " || ' ' || ".join(["word"] + [f"w{i}" for i in range(1, m.SHINGLE)])
    leads = ", ".join(f"lead(word, {i}) OVER seq AS w{i}" for i in range(1, m.SHINGLE))
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents
), word_rows AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
), runs AS (
  SELECT doc_id, word, {leads} FROM word_rows WINDOW seq AS (PARTITION BY doc_id ORDER BY pos)
), sets AS (
  SELECT DISTINCT doc_id, {shingle} AS shingle FROM runs WHERE w{m.SHINGLE - 1} IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM docs WHERE len(words) BETWEEN 1 AND {m.SHINGLE - 1}
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * common.n >= {m.PERCENT} * (a.n + b.n - common.n)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM docs UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), least AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""


def passage_sql() -> str:
    width = suffix_tree_dedup.WIDTH
    return rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), word_rows AS MATERIALIZED (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - {width - 2})) AS pos, words FROM docs WHERE len(words) >= {width}
), named AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + {width - 1}], ' ')) AS name FROM windows
), repeated AS (
  SELECT doc_id, pos FROM named QUALIFY count(*) OVER (PARTITION BY name) > 1
), marked AS (
  SELECT w.doc_id, w.pos, w.word, r.pos AS hit,
    max(r.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos) > w.pos - {width} AS gone
  FROM word_rows w LEFT JOIN repeated r ON r.doc_id = w.doc_id AND r.pos = w.pos
), spans AS (
  SELECT *, coalesce(gone, false) AS out, lag(coalesce(gone, false), 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM marked
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT before) AS n_spans,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT out), '') AS kept
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  coalesce(n_spans, 0) AS n_spans
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""


def secret_sql() -> str:
    """Every rule on every text, without an index."""
    rules = []
    for kind, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        rules.append(
            f"SELECT row, {kind} AS kind, '{rule.kind}' AS name, {rule.least} AS least, string_split_regex(text, '{pattern}') AS gaps,"
            f" regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS counted FROM docs"
        )
    counts = ", ".join(f"count(*) FILTER (kind = {kind}) AS n_{rule.kind}" for kind, rule in enumerate(secret_scan.BASE_RULES))
    joined = "string_agg(concat(name, ':', first, ':', stop), ',' ORDER BY first, kind)"
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), searched AS ({" UNION ALL ".join(rules)}
), matches AS (
  SELECT row, kind, name, least, unnest(range(1, len(found) + 1)) AS pos, gaps, found, counted FROM searched WHERE len(found) > 0
), placed AS (
  SELECT row, kind, name, least, length(found[pos]) AS n, length(counted[pos]) AS n_counted,
    CAST(list_sum(list_transform(gaps[1:pos], lambda x: length(x))) + list_sum(list_transform(found[1:pos], lambda x: length(x))) AS BIGINT) AS stop
  FROM matches
), spans AS (
  SELECT *, stop - n AS first FROM placed WHERE n_counted >= least
), by_row AS (
  SELECT row, {counts}, {joined} FILTER (kind < {len(secret_scan.BASE_RULES)}) AS base, {joined} AS spans FROM spans GROUP BY row
)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secret_scan.BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_row USING (row)
"""


def audit_sql() -> str:
    """Every step of every order over all documents' masks, without cells or shared prefixes."""
    f = filter_audit
    letters = ", ".join(f"('{letter}', {1 << place})" for place, letter in enumerate(f.FILTERS))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), masked AS (
  SELECT doc_id, part, CASE WHEN len(words) < {f.LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < {f.LEAST_DISTINCT_PCT} * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {f.MOST_CAPITALS_PCT} * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '{f.SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM words
), flags AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS MATERIALIZED (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM masked LEFT JOIN flags USING (doc_id)
), letters(letter, bit) AS (VALUES {letters}
), prefixes AS (
  SELECT '' AS prefix, 0 AS before, '' AS letter, 0 AS bit, 0 AS step
  UNION ALL
  SELECT prefix || l.letter, before | p.bit, l.letter, l.bit, step + 1 FROM prefixes p JOIN letters l ON (before | p.bit) & l.bit = 0
), steps AS MATERIALIZED (
  SELECT part, prefix, letter, step, count(*) FILTER (mask & (before | bit) = 0) AS kept,
    count(*) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, count(*) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
    count(*) FILTER (mask = bit) AS unique_fails, count(*) FILTER (mask & bit <> 0 AND mask & before = 0 AND good) AS good_lost,
    count(*) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic) AS toxic_lost
  FROM prefixes, docs WHERE step > 0 GROUP BY ALL
), orders AS (
  SELECT prefix AS filter_order FROM prefixes WHERE step = {len(f.FILTERS)}
), rows AS (
  SELECT part, filter_order, letter, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost
  FROM orders JOIN steps ON starts_with(filter_order, prefix)
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM rows
"""


def repair_sql() -> str:
    """A table of lightest (cost, audit, text) per state, filled turn by turn with up to two inserts before each."""
    c = conversation_repair
    names = "CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END"
    after = "CASE WHEN state = 2 THEN 3 ELSE 2 END"
    # A checksum over the characters of the key, all of them ASCII.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    rounds = step
    byte = f"list_reduce(range(8), lambda c, i: {rounds}, xor(crc, code))"
    checksum = f"xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda crc, code: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"
    insert = f"SELECT conv, pos, {after} AS state, cost + {c.INSERT_COST} AS cost, audit || 'I' AS audit, list_append(made, {names} || ':') AS made FROM"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT *, {checksum} % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged
), ids AS (
  SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), turns AS MATERIALIZED (
  SELECT conv, p.turn, p.role, p.text, p.pos, left(p.role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 1
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2
      WHEN regexp_matches(text, '[.!?][ 	-
]*\z') THEN 0 ELSE 3 END AS fault,
    lag(left(p.role, 1)) OVER (PARTITION BY conv ORDER BY pos) || left(p.role, 1) AS pair
  FROM placed p JOIN ids i ON p.conv_id IS NOT DISTINCT FROM i.conv_id
), report AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv
), best AS (
  SELECT conv, CAST(0 AS BIGINT) AS pos, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made FROM ids
  UNION ALL
  SELECT conv, pos, state, cost, audit, made FROM (
    WITH none AS (SELECT conv, pos, state, cost, audit, made FROM best),
    one AS ({insert} none), two AS ({insert} one),
    ready AS (SELECT * FROM none UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two),
    here AS (SELECT r.*, t.role, t.text, t.initial, t.fault FROM ready r JOIN turns t ON t.conv = r.conv AND t.pos = r.pos + 1),
    done AS (
      SELECT conv, pos + 1 AS pos, state, cost + {c.DELETE_COST} AS cost, audit || 'D' AS audit, made FROM here
      UNION ALL
      SELECT conv, pos + 1, {after}, cost + {c.REROLE_COST} + CASE WHEN fault = 3 THEN {c.TRUNCATED_COST} ELSE 0 END, audit || 'R',
        list_append(made, {names} || ':' || text) FROM here WHERE fault IN (0, 3)
      UNION ALL
      SELECT conv, pos + 1, CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
        cost + CASE WHEN fault = 3 THEN {c.TRUNCATED_COST} ELSE 0 END, audit || 'K', list_append(made, role || ':' || text)
      FROM here WHERE fault IN (0, 3)
        AND ((state = 0 AND initial IN ('s', 'u')) OR (state IN (1, 3) AND initial = 'u') OR (state = 2 AND initial = 'a'))
    )
    SELECT *, row_number() OVER (PARTITION BY conv, state ORDER BY cost, audit) AS rank FROM done
  ) WHERE rank = 1
), finished AS (
  SELECT b.conv, b.state, b.cost, b.audit, b.made, b.pos FROM best b JOIN report r ON r.conv = b.conv AND r.n = b.pos
), ended AS (
  SELECT * FROM finished
  UNION ALL SELECT conv, {after}, cost + {c.INSERT_COST}, audit || 'I', list_append(made, {names} || ':'), pos FROM finished
  UNION ALL SELECT conv, 3, cost + 2 * {c.INSERT_COST}, audit || 'II', made || ['user:', 'assistant:'], pos FROM finished WHERE state <> 2
), chosen AS (
  SELECT * FROM ended WHERE state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN report USING (conv) LEFT JOIN chosen USING (conv)
"""


def build() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(),
        "op2_chat_format": CHAT_SQL,
        "op5_url_filters": url_sql(),
        "op6_minhash_dedup": near_duplicate_sql(),
        "op7_mixing": mixing_sql(),
        "op8_suffix_tree_dedup": passage_sql(),
        "op11_secret_scan": secret_sql(),
        "op12_filter_audit": audit_sql(),
        "op13_conversation_repair": repair_sql(),
    }
