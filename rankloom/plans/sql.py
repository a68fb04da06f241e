"""DuckDB counterparts of the rules, as text fragments that queries put together."""

from __future__ import annotations

#: Chunks stay whole up to this many times the maximum.
SLACK = 1.5

#: The format's patterns, written out here once more, so that a wrong one in the engine shows.
UNITS = r"(?:z.{7}){2,}|[zs].{7}[zs].{7}|[zsLEB].{7}"
BYTES = r"[89AB].(?:[89A-F].|[0-7].(?:[89A-F].|[0-7].[89A-F].|[0-7].)?)?|[0-7C-F]."
#: The patterns in DuckDB's dialect.
PARAGRAPH = r"(?s).*?(?:\n\n|\n[-=*]{3,}\n|\z)"
PARAGRAPH_END = r"(?:\n\n|\n[-=*]{3,}\n)\z"
SENTENCE = r"(?s).*?(?:\n|[.!?][^\S\n]\s*|\z)"
WORDS = r"[ \t\n\f\r]?[0-9A-Za-z_]+|[ \t\n\f\r]?[^ \t\n\f\r0-9A-Za-z_]+|[ \t\n\f\r]+"


def pieces(text: str, pattern: str = PARAGRAPH) -> str:
    return f"list_filter(regexp_extract_all({text}, '{pattern}'), lambda v: v <> '')"


def chunks(source: str, key: str, least: int, most: int, name: str = "chunks") -> str:
    """CTEs ending in ``name`` ({key}, chunk_no, chunk) from a relation with {key} and text."""
    empty = "{'o': []::VARCHAR[], 'c': ''}"
    return f"""
{name}_packed AS (
  SELECT {key}, list_reduce({pieces("text")}, lambda a, v:
    CASE WHEN length(a.c) + length(v) > {most} AND length(a.c) >= {least} THEN {{'o': list_append(a.o, a.c), 'c': v}}
      WHEN length(a.c) + length(v) >= {least} AND regexp_matches(v, '{PARAGRAPH_END}') THEN {{'o': list_append(a.o, a.c || v), 'c': ''}}
      ELSE {{'o': a.o, 'c': a.c || v}} END, {empty}) AS s FROM {source}),
{name}_whole AS (
  SELECT {key}, CASE WHEN s.c = '' THEN s.o
    WHEN length(s.c) < {least} AND len(s.o) > 0 AND length(s.o[len(s.o)]) + length(s.c) <= {SLACK * most}
      THEN list_append(s.o[1:len(s.o) - 1], s.o[len(s.o)] || s.c)
    ELSE list_append(s.o, s.c) END AS w FROM {name}_packed),
{name}_each AS (SELECT {key}, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM {name}_whole),
{name}_cut AS (
  SELECT {key}, i, CASE WHEN length(x) > {SLACK * most} THEN list_reduce({pieces("x", SENTENCE)}, lambda a, v:
      CASE WHEN length(a.c) + length(v) > {most} AND length(a.c) >= {least} THEN {{'o': list_append(a.o, a.c), 'c': v}}
        ELSE {{'o': a.o, 'c': a.c || v}} END, {empty}) ELSE {{'o': [x], 'c': ''}} END AS s FROM {name}_each),
{name}_lists AS (
  SELECT {key}, flatten(list(CASE WHEN s.c = '' THEN s.o ELSE list_append(s.o, s.c) END ORDER BY i)) AS l FROM {name}_cut GROUP BY {key}),
{name} AS (SELECT {key}, unnest(l) AS chunk, (generate_subscripts(l, 1) - 1)::INT AS chunk_no FROM {name}_lists)"""


def tokens(source: str = "chunks", name: str = "tokens") -> str:
    """doc_id, chunk_no, pos, token."""
    return f"""
{name} AS (
  SELECT doc_id, chunk_no, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id, chunk_no, regexp_extract_all(chunk, '{WORDS}') AS t FROM {source}))"""


#: Two to the bits of an id in a context.
ID = 2097152


def _contexts() -> str:
    return f"""0::BIGINT AS c0, (p1 + 1)::BIGINT AS c1, (p1 + 1)::BIGINT + (p2 + 1)::BIGINT * {ID} AS c2,
    (p1 + 1)::BIGINT + (p2 + 1)::BIGINT * {ID} + (p3 + 1)::BIGINT * {ID * ID} AS c3"""


def model(train: str, k: int = 64, least: int = 2) -> str:
    """vocab and ranks, for contexts of 0 to 3 tokens, from a relation of token rows."""
    return f"""
vocab AS MATERIALIZED (
  SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) - 1)::INT AS token_id
  FROM (SELECT token, count(*) AS n FROM {train} GROUP BY token)),
train_rows AS (
  SELECT token_id, lag(token_id, 1) OVER o AS p1, lag(token_id, 2) OVER o AS p2, lag(token_id, 3) OVER o AS p3
  FROM {train} JOIN vocab USING (token) WINDOW o AS (PARTITION BY doc_id, chunk_no ORDER BY pos)),
train_ctx AS (SELECT token_id, unnest([c0, c1, c2, c3]) AS ctx FROM (SELECT token_id, {_contexts()} FROM train_rows)),
grams AS (SELECT ctx, token_id, count(*) AS n FROM train_ctx WHERE ctx IS NOT NULL GROUP BY ALL),
ranks AS MATERIALIZED (
  SELECT * FROM (
    SELECT ctx, token_id, n, (row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token_id) - 1)::INT AS rank
    FROM grams WHERE n >= {least} OR ctx < {ID}) WHERE rank < {k}),
listed AS MATERIALIZED (SELECT ctx, count(*) AS n FROM ranks GROUP BY ctx)"""


def items(source: str, name: str = "items") -> str:
    """Token ids, with code points above the vocabulary for tokens outside it, and the ids before them."""
    return f"""
{name}_lists AS (
  SELECT doc_id, chunk_no, pos, CASE WHEN token_id IS NOT NULL THEN [token_id::BIGINT]
    ELSE list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT + vocab_size) END AS l
  FROM {source} LEFT JOIN vocab USING (token), (SELECT count(*) AS vocab_size FROM vocab)),
{name}_each AS (SELECT doc_id, chunk_no, pos, unnest(l) AS token_id, generate_subscripts(l, 1) AS sub FROM {name}_lists),
{name} AS MATERIALIZED (
  SELECT doc_id, chunk_no, (row_number() OVER o - 1)::INT AS pos, token_id::INT AS token_id, lag(token_id, 1) OVER o AS p1, lag(token_id, 2) OVER o AS p2, lag(token_id, 3) OVER o AS p3
  FROM {name}_each WINDOW o AS (PARTITION BY doc_id, chunk_no ORDER BY pos, sub))"""


def looked(source: str = "items", name: str = "looked") -> str:
    """Of each item, its rank in the lists of its contexts and their lengths."""
    joins = " ".join(f"LEFT JOIN ranks r{j} ON r{j}.ctx = i.c{j} AND r{j}.token_id = i.token_id LEFT JOIN listed n{j} ON n{j}.ctx = i.c{j}" for j in range(4))
    return f"""
{name} AS MATERIALIZED (
  SELECT i.doc_id, i.chunk_no, i.pos, i.token_id, {", ".join(f"r{j}.rank AS r{j}, coalesce(n{j}.n, 0) AS n{j}" for j in range(4))}
  FROM (SELECT *, {_contexts()} FROM {source}) i {joins})"""


def coded(source: str = "looked", name: str = "coded", longest: int = 3) -> str:
    """The longest context that lists the token decides; the lists before it are counted."""
    tries = [" + ".join([f"r{j}", *(f"n{m}" for m in range(j + 1, longest + 1))]) for j in range(longest, -1, -1)]
    return f"""
{name} AS (
  SELECT doc_id, chunk_no, pos, CASE WHEN pos > 0 AND rank < 64 THEN 'r' ELSE 'e' END AS kind, (CASE WHEN pos > 0 AND rank < 64 THEN rank ELSE token_id END)::INT AS value
  FROM (SELECT *, coalesce({", ".join(tries)}) AS rank FROM {source}))"""


def streams(source: str = "coded", name: str = "streams") -> str:
    """doc_id and written: the tokens of a document as text, breaks between chunks."""
    return f"""
{name}_chunks AS (
  SELECT doc_id, chunk_no, string_agg({written("kind", "value")}, '' ORDER BY pos) AS w FROM {source} GROUP BY ALL),
{name} AS (SELECT doc_id, string_agg(w, 'B0000000' ORDER BY chunk_no) AS written FROM {name}_chunks GROUP BY doc_id)"""


def written(kind: str, value: str) -> str:
    return f"""CASE WHEN {kind} = '<BREAK>' THEN 'B' WHEN {kind} <> 'r' THEN 'E' WHEN {value} = 0 THEN 'z'
    WHEN {value} < 8 THEN 's' ELSE 'L' END || printf('%07X', {value})"""


def units(text: str) -> str:
    return f"regexp_extract_all({text}, '{UNITS}')"


def _value(u: str, at: int = 0) -> str:
    return f"('0x' || {u}[{2 + 8 * at}:{8 + 8 * at}])::BIGINT"


def explicit_hex(v: str) -> str:
    part = lambda shift, mask, add=0: f"printf('%02X', ((({v}) >> {shift}) & {mask}) | {add})"
    last = part(0, 127, 128)
    return f"""CASE WHEN {v} < 8192 THEN {part(7, 63, 128)} || {last}
    WHEN {v} < 1048576 THEN {part(14, 63, 128)} || {part(7, 127)} || {last}
    ELSE {part(21, 63, 128)} || {part(14, 127)} || {part(7, 127)} || {last} END"""


def width(v: str) -> str:
    return f"CASE WHEN {v} < 8192 THEN 2 WHEN {v} < 1048576 THEN 3 ELSE 4 END"


_RUN = "u[1] = 'z' AND length(u) > 8 AND u[9] = 'z'"


def encoded(text: str, window: str) -> str:
    """Upper-case hex of a stream's bytes."""
    n = "(length(u) // 8 - 1)"
    unit = f"""CASE WHEN {_RUN} THEN repeat('FE', ({n} // 62)::INT) || printf('%02X', {n} % 62 + 1 + 192)
    WHEN length(u) = 16 THEN printf('%02X', ({_value("u")} << 3) | {_value("u", 1)} | 64)
    WHEN u[1] = 'E' THEN {explicit_hex(_value("u"))} WHEN u[1] = 'B' THEN 'FF' ELSE printf('%02X', {_value("u")}) END"""
    return f"{explicit_hex(window)} || coalesce(array_to_string(list_transform({units(text)}, lambda u: {unit}), ''), '')"


def packed_size(text: str, window: str) -> str:
    unit = f"CASE WHEN {_RUN} THEN ceil(length(u) / 8 / 62)::BIGINT WHEN u[1] = 'E' THEN {width(_value('u'))} ELSE 1 END"
    return f"({width(window)} + coalesce(list_sum(list_transform({units(text)}, lambda u: {unit})), 0))::BIGINT"


def decoded(hexed: str) -> str:
    """Units of a byte stream in hex as lists of written tokens, the header left out."""
    byte = lambda i: f"('0x' || u[{2 * i + 1}:{2 * i + 2}])::BIGINT"
    explicit = f"""CASE length(u) WHEN 2 THEN {byte(0)} & 63 WHEN 4 THEN (({byte(0)} & 63) << 7) | ({byte(1)} & 127)
    WHEN 6 THEN (({byte(0)} & 63) << 14) | (({byte(1)} & 127) << 7) | ({byte(2)} & 127)
    ELSE (({byte(0)} & 63) << 21) | (({byte(1)} & 127) << 14) | (({byte(2)} & 127) << 7) | ({byte(3)} & 127) END"""
    rank = lambda v: f"CASE WHEN {v} = 0 THEN 'z' WHEN {v} < 8 THEN 's' ELSE 'L' END || printf('%07X', {v})"
    unit = f"""CASE WHEN u = 'FF' THEN 'B0000000' WHEN regexp_matches(u, '^[89AB]') THEN 'E' || printf('%07X', {explicit})
    WHEN regexp_matches(u, '^[0-3]') THEN {rank(f"({byte(0)} & 63)")}
    WHEN regexp_matches(u, '^[4-7]') THEN {rank(f"(({byte(0)} >> 3) & 7)")} || {rank(f"({byte(0)} & 7)")}
    ELSE repeat('z0000000', ({byte(0)} & 63)::INT) END"""
    return f"array_to_string(list_transform(regexp_extract_all({hexed}, '{BYTES}')[2:], lambda u: {unit}), '')"
