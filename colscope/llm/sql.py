"""DuckDB twins of the queries that SQL can express; literals are written out, none come from the operators."""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    -- a control string costs one more character, a backslash too
    8 + 8 + 7 + length(role) + length(text)
      + (length(role || text) - length(replace(role || text, '\', '')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '<|', '#')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '<s>', '##')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '</s>', '###')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '[INST]', '#####')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '[/INST]', '######')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '<<SYS>>', '######')))
      + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '<</SYS>>', '#######'))) AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
ends AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM marked)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(prefix) FILTER (WHERE role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM ends GROUP BY conv_id
"""

OP3 = r"""
WITH RECURSIVE poly AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, poly.t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM bytes, poly),
keyed AS (
  SELECT doc_id, size, crc, row_number() OVER () AS r,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS k
  FROM sums),
walk AS (
  SELECT r, k, (-1)::BIGINT AS b, 0::BIGINT AS j FROM keyed
  UNION ALL
  SELECT r, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM walk WHERE j < 40)),
ends AS (SELECT r, b, j FROM walk WHERE j >= 40)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, b::INT AS shard,
  row_number() OVER (PARTITION BY b ORDER BY
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || crc::VARCHAR || ':' || size::VARCHAR), 1, 8))::BIGINT,
    doc_id NULLS FIRST, crc, size) - 1 AS slot,
  (CASE WHEN j = 40 THEN 40 ELSE b END)::INT AS grown_shard
FROM keyed JOIN ends USING (r)
"""

OP7 = r"""
WITH templates(license, body) AS (VALUES
  ('MIT (notice)', 'Released under the MIT License.'),
  ('MIT (licensed)', 'Licensed under the MIT License.'),
  ('Apache-2.0 (notice)', 'Licensed under the Apache License, Version 2.0.'),
  ('GPL-2.0 (notice)', 'This work is licensed under the GNU General Public License, version 2.'),
  ('GPL-3.0 (notice)', 'This work is licensed under the GNU General Public License, version 3.'),
  ('CC-BY-4.0 (notice)', 'Licensed under CC BY 4.0.'),
  ('CC-BY-SA-4.0 (notice)', 'Licensed under CC BY-SA 4.0.'),
  ('CC-BY-NC-4.0 (notice)', 'Licensed under CC BY-NC 4.0.'),
  ('CC-BY-ND-4.0 (notice)', 'Licensed under CC BY-ND 4.0.'),
  ('All rights reserved', 'All rights reserved.'),
  ('MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
  ('ISC', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
  ('Apache-2.0 (header)', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
  ('GPL-3.0 (header)', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
  ('GPL-2.0 (header)', 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.'),
  ('MPL-2.0 (header)', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
  ('BSD (redistribution)', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:')),
parts AS (
  SELECT DISTINCT doc_id, segment FROM (
    SELECT doc_id, text AS segment FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL)),
spoken AS (
  SELECT 's' AS side, row_number() OVER () AS id, doc_id, NULL AS license, trim(regexp_replace(lower(segment), '[^a-z0-9]+', ' ', 'g')) AS words FROM parts
  UNION ALL SELECT 't', row_number() OVER (), NULL, license, trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')) FROM templates),
grams AS (
  SELECT side, id, doc_id, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT *, string_split(words, ' ') AS w FROM spoken)),
scores AS (
  SELECT s.doc_id, t.license, 2 * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g))::DOUBLE AS dice
  FROM grams s JOIN grams t ON s.side = 's' AND t.side = 't' AND len(s.g) > 0 AND len(t.g) BETWEEN len(s.g) / 2.0 AND len(s.g) * 2)
SELECT doc_id, license, round(max(dice), 6) AS dice FROM scores WHERE dice >= 0.8 GROUP BY doc_id, license
"""

#: CRC-32 of the ASCII text ``t`` of a table (k, t): the table of the polynomial, and one step a character.
_CRC = r"""
crc_table AS (
  SELECT list(v ORDER BY i) AS bits FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
crc AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(crc_in.t, ''), lambda s: ascii(s)::BIGINT)),
                            lambda c, x: xor(c >> 8, crc_table.bits[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM crc_in, crc_table)"""

OP11 = r"""
WITH said AS (
  SELECT conv_id AS c, turn, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT c, d, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS place FROM said),
crc_in AS (SELECT DISTINCT c AS k, c::VARCHAR AS t FROM said),""" + _CRC + r""",
convs AS (SELECT k AS c, crc % 4 AS h, k - k % 20 AS base FROM crc),
rebuilt AS (
  SELECT convs.c, 0 AS part, p.place, p.d, p.words FROM convs JOIN placed p ON p.c = convs.base AND p.place <= convs.h
  UNION ALL SELECT convs.c, 1, p.place, p.d, p.words FROM convs JOIN placed p ON p.c = convs.c AND p.place > convs.h),
paths AS (
  SELECT c, row_number() OVER w AS depth, string_agg(d, '') OVER w AS node, words FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM convs),
steps AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY c ORDER BY depth) IS NULL AS last FROM paths),
nodes AS (SELECT depth, node, any_value(parent) AS parent, any_value(words) AS words, min(c) AS low, count(*) AS n,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM steps GROUP BY depth, node),
kin AS (SELECT parent AS node, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN kin USING (node)),
-- the nodes on the way to a node are those of its smallest member
below AS (
  SELECT s.node, sum((f.children = 0)::INT) AS leaves, sum((f.n - 1) * f.words) AS saved
  FROM full_nodes f JOIN steps s ON s.c = f.low AND s.depth <= f.depth GROUP BY s.node)
SELECT f.low AS conv_id, f.depth, p.low AS parent_conv_id, f.n AS n_convs, f.children::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below b USING (node) LEFT JOIN nodes p ON p.node = f.parent
"""

OP12 = r"""
WITH RECURSIVE written AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g,
    coalesce(length(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
      || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
  FROM documents),
crc_in AS (SELECT r AS k, doc_id::VARCHAR AS t FROM written WHERE doc_id IS NOT NULL),""" + _CRC + r""",
leaves AS (
  SELECT r, doc_id, g, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || lowered, '-')) END AS other
  FROM written LEFT JOIN crc ON k = r),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
up AS (
  SELECT g, 0 AS level, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY g, level, pos // 8, n),
tops AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, node, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
beside AS (
  SELECT g, level, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY g, level, pos // 8 ORDER BY pos)),
beside_top AS (
  SELECT level, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
segs AS (
  SELECT r, level, a, b FROM placed JOIN beside ON beside.g = placed.g AND beside.pos = placed.pos // (8 ** beside.level)::BIGINT
  UNION ALL
  SELECT r, 1000 + level, a, b FROM placed JOIN tops ON tops.g = placed.g JOIN beside_top ON beside_top.pos = tops.pos // (8 ** beside_top.level)::BIGINT),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM segs),
fold AS (
  SELECT r, 0 AS k, coalesce(other, leaf) AS node FROM placed
  UNION ALL
  SELECT fold.r, fold.k + 1, sha256(a || node || b) FROM fold JOIN numbered ON numbered.r = fold.r AND numbered.k = fold.k + 1),
folded AS (SELECT r, arg_max(node, k) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY level)) AS proof FROM segs GROUP BY r),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, tops.node AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN tops USING (g) JOIN folded USING (r) LEFT JOIN proofs USING (r) CROSS JOIN root
"""

OP13 = r"""
WITH RECURSIVE sizes AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sizes GROUP BY source),
-- rounds: what lies above three times a source's size goes to the others by weight
rounds AS (
  SELECT 0 AS k, source, source_size, w, false AS fixed FROM sources
  UNION ALL
  SELECT k + 1, source, source_size, w, fixed OR 3 * source_size::HUGEINT * open_w < rest * w
  FROM (SELECT *, sum(CASE WHEN NOT fixed THEN w ELSE 0 END) OVER () AS open_w,
          sum(source_size) OVER () - 3 * sum(CASE WHEN fixed THEN source_size ELSE 0 END) OVER () AS rest FROM rounds) WHERE k < 25),
shares AS (
  SELECT *, sum(CASE WHEN NOT fixed THEN w ELSE 0 END) OVER () AS parts,
    sum(source_size) OVER () - 3 * sum(CASE WHEN fixed THEN source_size ELSE 0 END) OVER () AS part
  FROM rounds WHERE k = 25),
targets AS (
  SELECT source, source_size, w, fixed, part::HUGEINT AS part, parts::HUGEINT AS parts,
    CASE WHEN fixed THEN source_size * 3.0::DOUBLE ELSE part::DOUBLE * w / greatest(parts, 1)::DOUBLE END AS target,
    ('0x' || substr(md5('0:' || coalesce('=' || source, '-')), 1, 5))::BIGINT AS shift
  FROM shares),
-- longest first; documents of the same length in an order that the engines share
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, md5(coalesce(text, '')), doc_id NULLS FIRST) AS place FROM sizes),
taken AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 WHEN fixed THEN 3
    ELSE ((place * part * w * 1048576 + shift * parts * source_size) // (1048576 * parts * source_size)
      - ((place - 1) * part * w * 1048576 + shift * parts * source_size) // (1048576 * parts * source_size)) END::BIGINT AS copies
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
