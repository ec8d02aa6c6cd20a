"""SQL twins of those queries that SQL can express, for DuckDB."""

OP10 = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM s
), w AS (
  SELECT *, (source_rank - 1) % 3 + 1 AS weight, CAST(3.0 AS DOUBLE) * source_size / ((source_rank - 1) % 3 + 1) AS ratio FROM r
), l AS (
  SELECT *, row_number() OVER f AS place,
         (CAST((sum(source_size) OVER ()) - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
          / CAST((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) AS level
  FROM w WINDOW f AS (ORDER BY ratio, source_rank)
), p AS (
  SELECT place, level FROM l WHERE level <= ratio ORDER BY place LIMIT 1
), t AS (
  SELECT l.*, CASE WHEN p.place IS NULL OR l.place < p.place THEN CAST(source_size * 3 AS DOUBLE) ELSE p.level * weight END AS target
  FROM l LEFT JOIN p ON TRUE
), q AS (
  SELECT *, least(CAST(floor(target) AS BIGINT), source_size * 3) AS quota FROM t
), a AS (
  SELECT d.*, q.source_size, q.target, q.quota, q.source_rank,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_word
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS rounds FROM a
), m AS (
  SELECT *, CAST(rounds * size + least(size, greatest(quota - rounds * source_size - at_word, 0)) AS BIGINT) AS taken,
         at_word::DOUBLE / nullif(quota, 0)::DOUBLE AS share
  FROM k
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN
         CASE (source_rank - 1) % 3
           WHEN 0 THEN 2.0 * share / (1.5 + sqrt(greatest(2.25 - 2.0 * share, 0)))
           WHEN 1 THEN share
           ELSE CASE WHEN share < 0.25 THEN share * 2 ELSE 0.5 + 2.0 * (share - 0.25) / (0.5 + sqrt(0.25 + 8.0 * (share - 0.25))) END
         END END AS position
FROM m
"""


OP11 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), e AS (
  SELECT r, s AS i, md5(array_to_string(w[s:s + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
), c AS (
  SELECT r, i, count(*) OVER (PARTITION BY k) > 1 AS hit FROM e
), m AS (
  SELECT p.r, p.i, word, coalesce(max(CAST(hit AS INTEGER)) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM p LEFT JOIN c ON p.r = c.r AND p.i = c.i
), s AS (
  SELECT r, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM m GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r
"""


def _product_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Exact integer k-means, a pair of statements per round."""
    near = (
        "SELECT r, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT x.r, x.part, b.entry, "
        "list_sum(list_transform(list_zip(x.piece, b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM x JOIN {b} b USING (part)) GROUP BY r, part"
    )
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 4096) AS BIGINT)) AS ints FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"x AS MATERIALIZED (SELECT r, p AS part, ints[p * len(ints) // {parts} + 1 : (p + 1) * len(ints) // {parts}] AS piece FROM v, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, piece FROM x WHERE r <= {entries})",
    ]
    for k in range(rounds):
        total = "CAST(sum(value) AS HUGEINT)"
        steps.append(f"a{k} AS MATERIALIZED ({near.format(b=f'b{k}')})")
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS piece FROM (SELECT part, entry, place, {total} AS total, count(*) AS n "
            f"FROM (SELECT x.part, a.entry, unnest(piece) AS value, generate_subscripts(piece, 1) AS place FROM x JOIN a{k} a USING (r, part)) GROUP BY part, entry, place) GROUP BY part, entry)"
        )
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(CAST(m.piece AS BIGINT[]), o.piece) AS piece FROM b{k} o LEFT JOIN m{k} m USING (part, entry))")
    steps.append(f"last AS MATERIALIZED ({near.format(b=f'b{rounds}')})")
    steps.append("s AS (SELECT r, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM last GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    tail = "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN s USING (r), h"
    return "WITH " + ", ".join(steps) + " " + tail


OP12 = _product_codes()

OP13 = """
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), g AS (
  SELECT id, run, count(*) AS n FROM r GROUP BY id, run
), k AS (
  SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM g
), y AS (
  SELECT id, run, n, list_transform(range(1, len(x) // 2 + 1), lambda i: CAST((instr('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i]) - 1 AS BIGINT)) AS b FROM k
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, e: xor(c >> 8, tab[xor(c & 255, e) + 1]))) AS h FROM y, t
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h
), v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY word HAVING sum(n) >= 5 AND len(word) >= 6
), c AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)
), p AS (
  SELECT c.word, d.word AS other, d.n AS m FROM c JOIN c d ON c.i = d.i AND c.a = d.a AND c.b = d.b AND c.word <> d.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.a || c.b = v.word
  UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.a || c.b = v.word
), q AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN q USING (word)
), z AS (
  WITH RECURSIVE up AS (
    SELECT word, word AS last, form AS next FROM f
    UNION ALL SELECT up.word, up.next, f.form FROM up JOIN f ON up.next = f.word
  ) SELECT word, last AS root FROM up WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""

ORACLES = {"op10_curriculum_mix": OP10, "op11_debruijn_substrings": OP11, "op12_hilbert_codes": OP12, "op13_spelling_variants": OP13}
