"""SQL that returns the rows of a query from the same tables, for the operators that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """The unsigned crc32 of a text of ASCII characters, bit by bit."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    byte = "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}))"


def prefix_trie() -> str:
    """Rebuilt conversations as lists of digests; every prefix is a list of its own, subtrees by comparing lists."""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '{WORD}')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, {crc32("conv_id::VARCHAR")} % 4 AS h, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(words ORDER BY turn NULLS FIRST, key) AS words
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.keys[1 : c.h], []), c.keys[c.h + 1 :]) AS keys, list_concat(coalesce(b.words[1 : c.h], []), c.words[c.h + 1 :]) AS words
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, depth, keys[1 : depth] AS node, coalesce(words[depth], 0) AS words, depth = len(keys) AS ends
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT min(conv_id) AS conv_id, depth, node, node[1 : depth - 1] AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.node = c.node
), subtrees AS (
  SELECT u.depth, u.node, CAST(sum(v.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves
  FROM counted u JOIN counted v ON v.depth >= u.depth AND v.node[1 : u.depth] = u.node GROUP BY u.depth, u.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON n.depth = s.depth AND n.node = s.node
LEFT JOIN counted p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.parent
"""


def merkle_manifest(levels: int = 5, fanout: int = 16) -> str:
    """Lists of hashes per source, level by level; ``levels`` are enough for ``fanout`` ** ``levels`` rows of a source."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    def joined(hashes: str) -> str:
        return f"coalesce(array_to_string({hashes}, ''), '')"

    def up(nodes: str) -> str:
        parents = f"list_transform(range(0, len({nodes}), {fanout}), lambda i: sha256(array_to_string({nodes}[i + 1 : i + {fanout}], '')))"
        return f"CASE WHEN len({nodes}) > 1 THEN {parents} ELSE {nodes} END"

    def sides(tree: str, at: str, k: int) -> list[str]:
        place = f"{at} // {fanout**k}"
        run = f"({place}) // {fanout} * {fanout}"
        more = f"len({tree}{k}) > 1"
        return [
            f"CASE WHEN {more} THEN {joined(f'{tree}{k}[{run} + 1 : {place}]')} ELSE '' END AS {tree}_left{k}",
            f"CASE WHEN {more} THEN {joined(f'{tree}{k}[{place} + 2 : {run} + {fanout}]')} ELSE '' END AS {tree}_right{k}",
            f"{more} AS {tree}_more{k}",
        ]

    steps = [(tree, k) for tree in ("leaf", "source") for k in range(levels)]
    tables = [
        f"""hashed AS (
  SELECT doc_id, source, {leaf("text")} AS h, {leaf("lowered")} AS lower_h, {crc32("doc_id::VARCHAR")} % 5 = 0 AS tampered
  FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS lowered FROM documents)
)""",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS place FROM hashed)",
        "trees0 AS (SELECT source, list(h ORDER BY place) AS leaf0 FROM leaves GROUP BY source)",
        *[f"trees{k + 1} AS (SELECT *, {up(f'leaf{k}')} AS leaf{k + 1} FROM trees{k})" for k in range(levels)],
        f"sources AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS source_place FROM trees{levels})",
        f"top0 AS (SELECT list(leaf{levels}[1] ORDER BY source_place) AS source0 FROM sources)",
        *[f"top{k + 1} AS (SELECT *, {up(f'source{k}')} AS source{k + 1} FROM top{k})" for k in range(levels)],
        f"""fold0 AS (
  SELECT v.doc_id, h AS leaf, leaf{levels}[1] AS subroot, source{levels}[1] AS root, CASE WHEN tampered THEN lower_h ELSE h END AS folded0,
         {", ".join(x for tree, k in steps for x in sides(tree, "place" if tree == "leaf" else "source_place", k))}
  FROM leaves v JOIN sources s ON v.source IS NOT DISTINCT FROM s.source, top{levels}
)""",
        *[
            f"fold{n + 1} AS (SELECT *, CASE WHEN {tree}_more{k} THEN sha256({tree}_left{k} || folded{n} || {tree}_right{k}) ELSE folded{n} END AS folded{n + 1} FROM fold{n})"
            for n, (tree, k) in enumerate(steps)
        ],
    ]
    proof = " || ".join(f"{tree}_left{k} || {tree}_right{k}" for tree, k in steps)
    last = len(steps)
    return f"""
WITH {", ".join(tables)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, folded{last} AS folded_root, folded{last} = root AS verified FROM fold{last}
"""


def jaccard_components(size: int = 4, percent: int = 85) -> str:
    """All pairs that share a sequence of words, counted; what is reachable by recursion. For small tables."""
    return f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
    ELSE list_transform(range(0, greatest(len(words) - {size} + 1, 1)), lambda i: array_to_string(words[i + 1 : i + {size}], ' ')) END) AS shingles
  FROM texts
), members AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
edges AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (min(a.n) + min(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.shingles)
"""
