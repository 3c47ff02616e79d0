"""SQL of the registered queries of this package."""

from __future__ import annotations


def _spans(kind: str, place: int, pattern: str, test: str, group: int = 0) -> str:
    """Spans of one kind of every text, from the lengths of matches and what lies between."""
    return f"""
      SELECT doc_id, '{kind}' AS kind, {place} AS place, (b - length(m))::BIGINT AS s, b AS e FROM (
        SELECT doc_id, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b
        FROM (
          SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g,
                 unnest(gaps[:len(ms)]) AS gap
          FROM (
            SELECT doc_id, regexp_extract_all(t, p, 0) AS ms, regexp_extract_all(t, p, {group}) AS gs,
                   string_split_regex(t, p) AS gaps
            FROM (SELECT doc_id, coalesce(text, '') AS t, '{pattern.replace("'", "''")}' AS p
                  FROM documents)
          )
        )
      ) WHERE {test}"""


def _digest(spans: list[str], names: list[str], order: str) -> str:
    counts = ", ".join(
        f"coalesce(count(*) FILTER (kind = '{n}'), 0) AS n_{n}" for n in names
    )
    return f"""
    WITH spans AS ({" UNION ALL ".join(spans)}),
    found AS (
      SELECT doc_id, {counts},
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) AS spans,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})
               FILTER (kind IN ({", ".join(f"'{n}'" for n in names)})) AS base
      FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, {", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n in names)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN found USING (doc_id)"""


SECRETS = _digest(
    [
        _spans(
            "assign",
            0,
            r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "length(g) >= 6",
            2,
        ),
        _spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20"),
        _spans("hex", 2, "[0-9a-f]+", "length(m) >= 24"),
        _spans("pem", 3, r"-----BEGIN\x20[A-Z0-9\x20]*PRIVATE\x20KEY-----", "true"),
    ],
    ["assign", "access", "hex"],
    "s, place",
)

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN ({_DIGITS})[-i]::INT
       ELSE ({_DIGITS})[-i]::INT * 2 // 10 + ({_DIGITS})[-i]::INT * 2 % 10 END)) % 10 = 0"""

PERSONAL = _digest(
    [
        _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _spans(
            "ip",
            1,
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "list_bool_and(list_transform(string_split(m, '.'), lambda x: x::HUGEINT <= 255))",
        ),
        _spans(
            "card",
            2,
            r"[0-9]([\x20-]?[0-9])+",
            f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END",
        ),
        _spans(
            "phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"
        ),
    ],
    ["email", "ip", "card", "phone"],
    "place, s",
)

EXACT = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (g ORDER BY doc_id) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
WINDOW g AS (PARTITION BY text_sha256)"""

# The checksum of a text, byte by byte, over the table of the reflected polynomial.
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SHARDS = f"""
WITH entries AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {_STEP}) AS c
    FROM (SELECT unnest(range(256)) AS n))
),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS t FROM documents
),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]))) AS text_crc32
  FROM sized, entries
),
placed AS (
  SELECT *, (coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             * 24 // sum(size) OVER ())::INT AS shard
  FROM summed
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       NULL::INT AS grown_shard
FROM placed"""

# Two trees of the same shape: one per source (t is its rank), one over the subroots.
_LEVELS = """
{name} AS (
  SELECT t, 0 AS lvl, i, n, h FROM {leaves}
  UNION ALL
  SELECT t, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY t, lvl, i // 3, n
),
{name}_ways AS (
  SELECT t, lvl, i, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY t, lvl, i // 3 ORDER BY i)
)"""
_CLIMBED = """
{name} AS (
  SELECT {columns}, {t} AS t, 0 AS lvl, {i} AS i, {folded} AS folded, {proof} AS proof, false AS over FROM {start}
  UNION ALL
  SELECT {columns}, t, c.lvl + (w.t IS NOT NULL)::INT, CASE WHEN w.t IS NULL THEN c.i ELSE c.i // 3 END,
         CASE WHEN w.t IS NULL THEN folded ELSE sha256(w.l || folded || w.r) END,
         CASE WHEN w.t IS NULL THEN proof ELSE proof || w.l || w.r END, w.t IS NULL
  FROM {name} c LEFT JOIN {ways} w USING (t, lvl, i) WHERE NOT over
)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    fields = [_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


MERKLE = f"""
WITH RECURSIVE entries AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {_STEP}) AS c
    FROM (SELECT unnest(range(256)) AS n))
),
chosen AS (
  SELECT d.*, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]))) % 2 = 0 AS altered
  FROM documents d, entries
),
leaves AS (
  SELECT doc_id, {_leaf("text")} AS h,
         CASE WHEN altered THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM chosen
),
{_LEVELS.format(name="own", leaves="leaves")},
subroots AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM own WHERE n = 1),
{_LEVELS.format(name="upper", leaves="subroots")},
{_CLIMBED.format(name="first", columns="doc_id, leaf, source_rank", t="t", i="i", folded="other", proof="''", ways="own_ways", start="(SELECT *, h AS leaf, t AS source_rank FROM leaves)")},
{_CLIMBED.format(name="last", columns="doc_id, leaf, source_rank", t="0", i="source_rank", folded="folded", proof="proof", ways="upper_ways", start="(SELECT * FROM first WHERE over)")}
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = u.h AS verified
FROM last JOIN subroots s ON s.i = source_rank, (SELECT h FROM upper WHERE n = 1) u
WHERE over"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS words FROM (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, words, count(*) AS f FROM grams GROUP BY lang, k, words),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, words, f AS a FROM f WHERE k >= 2 AND f >= 30),
cuts AS (
  SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.words = c.words[:cut]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[cut + 1:]
),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
),
inner_words AS (
  SELECT lang, words[i:i + s - 1] AS words, max(a) AS most FROM (
    SELECT *, unnest(range(1, k - s + 2)) AS i
    FROM (SELECT *, unnest(range(2, k)) AS s FROM candidates WHERE k >= 3))
  GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.words, ' ')) AS rank
  FROM best b JOIN totals USING (lang) LEFT JOIN inner_words i ON i.lang = b.lang AND i.words = b.words
  WHERE most IS NULL OR 100 * most < 80 * a)
WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op3_blob_ledger": SECRETS,
    "op5_anchor_expansion": PERSONAL,
    "op6_patricia_owners": EXACT,
    "op9_prefix_sums": SHARDS,
    "op11_setm_phrases": COLLOCATIONS,
    "op13_recursive_climb": MERKLE,
}
