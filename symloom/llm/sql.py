"""DuckDB SQL of the training-data queries, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op7_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM items, range(1, greatest(len(w) - 10, 0) + 2) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM words, sizes, range(1, len(w) - n + 2) AS r(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, range(i, i + n) AS r(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op10_norm_bucketed_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""

# Label, words, least part of the distinct words, and whether the words must stand consecutively.
_TEMPLATES = """
  ('mit', 'mit license', 1.0, true), ('apache', 'apache license', 1.0, true), ('gpl', 'general public license', 1.0, true),
  ('all-rights-reserved', 'all rights reserved', 1.0, false),
  ('apache', 'licensed under the apache license version 2 0 you may not use this file except in compliance with the license', 0.8, false),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 0.8, false),
  ('cc-by', 'licensed under a creative commons attribution 4 0 international license', 0.8, false),
  ('cc-by-nc', 'licensed under cc by nc 4 0', 1.0, false),
  ('gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation', 0.8, false),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', 0.8, false),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files', 0.8, false),
  ('mpl', 'this source code form is subject to the terms of the mozilla public license v 2 0', 0.8, false),
  ('unlicense', 'this is free and unencumbered software released into the public domain', 0.8, false)
"""

ORACLES["op11_license_scan"] = rf"""
WITH templates AS (
  SELECT label, string_split(words, ' ') AS t, least_part, phrase FROM (VALUES {_TEMPLATES}) AS v(label, words, least_part, phrase)),
sized AS (
  SELECT *, list_distinct(t) AS d, CAST(pow(2, ceil(log2(len(t)))) AS BIGINT) AS step,
    CAST(ceil(least_part * len(list_distinct(t)) - 1e-9) AS BIGINT) AS need FROM templates),
words AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
steps AS (SELECT DISTINCT step FROM sized),
blocks AS (
  SELECT doc, step, list_distinct(w[k * step + 1 : k * step + 2 * step]) AS b
  FROM words, steps, range(0, CAST(ceil(len(w) / step) AS BIGINT)) AS r(k)),
near AS (
  SELECT doc, label, len(list_intersect(d, b)) / len(d) AS part
  FROM blocks JOIN sized USING (step) WHERE NOT phrase AND len(list_intersect(d, b)) >= need),
places AS (
  SELECT doc, label, i - 1 AS spot FROM words, sized, range(1, len(w) - len(t) + 2) AS r(i)
  WHERE phrase AND w[i : i + len(t) - 1] = t),
base AS (
  SELECT doc, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc),
every AS (
  SELECT doc, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
  FROM (SELECT doc, label, part FROM near UNION ALL SELECT doc, label, 1.0 FROM places) GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (doc) LEFT JOIN every USING (doc)
"""


def _clusters(rounds: int) -> str:
    """Assignment and means, written out for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (
  SELECT v.row, number, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS distance
  FROM v, c{k} c),
a{k} AS (SELECT row, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM d{k} GROUP BY row)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT number, i, sum(v.e[i]) AS total, count(*) AS n FROM a{k} JOIN v USING (row), range(1, 65) AS r(i) GROUP BY number, i),
f{k} AS (
  SELECT number, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM m{k} GROUP BY number),
c{k + 1} AS (SELECT number, coalesce(f.e, c.e) AS e FROM c{k} c LEFT JOIN f{k} f USING (number))""")
    return ",".join(steps)


ORACLES["op12_simplex_clusters"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS number, e
  FROM (SELECT e, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, e LIMIT 16)),{_clusters(3)},
i AS (SELECT number, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY number)
SELECT vec_id, CAST(number AS INTEGER) AS cluster, distance, cluster_inertia,
  (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM i) AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN v USING (row) JOIN i USING (number) JOIN c3 USING (number)
"""

ORACLES["op13_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT c, w, c - c % 100 AS base, xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.w, [])[1 : a.h], a.w[a.h + 1 :]) AS w FROM heads a LEFT JOIN own b ON b.c = a.base),
prefixes AS (SELECT c, w, d, w[1 : d] AS p FROM rebuilt, range(0, len(w) + 1) AS r(d)),
nodes AS (
  SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN d = len(w) THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM prefixes GROUP BY p),
kids AS (SELECT p[1 : depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
facts AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(n.p[depth].t) END AS saved FROM nodes n LEFT JOIN kids k ON k.p = n.p),
subtrees AS (
  SELECT p[1 : d] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM facts, range(0, depth + 1) AS r(d) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM facts f JOIN subtrees s ON s.p = f.p LEFT JOIN nodes u ON f.depth > 0 AND u.p = f.p[1 : f.depth - 1]
"""
