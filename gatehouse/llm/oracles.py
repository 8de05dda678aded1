"""DuckDB SQL of the queries that SQL can state, and of the base columns of others."""

from __future__ import annotations

from .line_suffix import MIN_WORDS
from .url_vocab import RULES, SOFT, STRICT

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def line_dedup(table: str = "documents", min_words: int = MIN_WORDS) -> str:
    """Deleted lines: those in a window of up to ``min_words`` lines, with enough words, that stands before, too."""
    spans = "\n  UNION ALL ".join(
        f"SELECT doc_id, place, rn, {n} AS k, list_slice(lines, rn, rn + {n - 1}) AS run FROM numbered "
        f"WHERE rn + {n - 1} <= len(lines) AND list_sum(list_slice(counts, rn, rn + {n - 1})) >= {min_words}" for n in range(1, min_words + 1))
    return f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {table}),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn
           FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
docs AS (SELECT doc_id, list(line ORDER BY pos) AS lines, list(n ORDER BY pos) AS counts, list(pos ORDER BY pos) AS places FROM worded GROUP BY doc_id),
numbered AS (SELECT doc_id, lines, counts, unnest(range(1, len(lines) + 1)) AS rn, unnest(places) AS place FROM docs),
runs AS ({spans}),
marked AS (SELECT doc_id, rn, k, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, rn) AS nth FROM runs),
gone AS (SELECT DISTINCT w.doc_id, w.pos FROM worded w JOIN marked m ON w.doc_id = m.doc_id AND w.rn >= m.rn AND w.rn < m.rn + m.k WHERE m.nth > 1),
cut AS (SELECT doc_id, list(pos ORDER BY pos)::INTEGER[] AS deleted FROM gone GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(c.deleted), 0)::BIGINT AS n_deleted, coalesce(array_to_string(c.deleted, ','), '') AS deleted,
       CASE WHEN c.deleted IS NULL THEN s.text
            ELSE array_to_string([s.ls[i + 1] FOR i IN range(len(s.ls)) IF NOT list_contains(c.deleted, i::INTEGER)], chr(10)) END AS text
FROM split s LEFT JOIN cut c USING (doc_id)"""


def url_filters() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(url_text, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"

    rules = sorted(RULES, key=lambda r: -len(r.text))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules}

    def case(value) -> str:
        return "CASE " + " ".join(f"WHEN {fits[r]} THEN '{value(r)}'" for r in rules) + " END"

    # A term may stand several times: hits are counted with their boundaries shared.
    strict = " + ".join(f"len(regexp_extract_all(regexp_replace(url_text, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){t.replace('-', '--')}($|[^a-z0-9])'))" for t in STRICT)
    soft = " + ".join(f"{hit(t)}::INTEGER" for t in SOFT)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
counted AS (SELECT *, lower(host || path) AS url_text FROM parts),
hits AS (SELECT *, ({strict})::INTEGER AS n_strict, ({soft})::INTEGER AS n_soft FROM counted)
SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
       coalesce({case(lambda r: r.verdict)}, CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM hits"""


def ngram_join(table: str = "documents", n: int = 3, percent: int = 90) -> str:
    """Equal sets are classes; classes that share a shingle of their rarest part are counted; links are followed to the end."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE worded AS (SELECT doc_id, {words} AS w FROM {table}),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})])) END AS s FROM worded),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT rep, len(s) AS size, unnest(s) AS g FROM classes),
ranked AS (SELECT rep, size, g, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS r
           FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM grams)),
heads AS (SELECT rep, size, g FROM ranked WHERE r <= size - ({percent} * size + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM heads a JOIN heads b ON a.g = b.g AND a.rep < b.rep
          AND 100 * least(a.size, b.size) >= {percent} * greatest(a.size, b.size)),
shared AS (SELECT p.a, p.b, len(x.s) + len(y.s) AS total, len(list_intersect(x.s, y.s)) AS common
           FROM pairs p JOIN classes x ON x.rep = p.a JOIN classes y ON y.rep = p.b),
links AS (SELECT a, b FROM shared WHERE 100 * common >= {percent} * (total - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN roots r ON r.a = c.rep"""


def merkle_proofs(table: str = "documents") -> str:
    """Trees level by level; crc32 is folded bit by bit."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    # An id's decimal digits are ASCII, so its characters are its bytes.
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
           f"lambda c, b: {bits}), 4294967295)")
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf(f"translate(text, '{upper}', '{lower}')")} AS changed,
           coalesce({crc} % 3 = 0, false) AS tampered FROM {table}),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
low(tree, level, i, h, size) AS (SELECT tree, 0, pos, leaf, size FROM placed
  UNION ALL SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (size + 7) // 8 FROM low WHERE size > 1 GROUP BY tree, level, i // 8, size),
tops AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS langs FROM low WHERE size = 1),
high(level, i, h, size) AS (SELECT 0, place, subroot, langs FROM tops
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (size + 7) // 8 FROM high WHERE size > 1 GROUP BY level, i // 8, size),
nodes AS (SELECT tree, level, i, h FROM low WHERE size > 1 UNION ALL
          SELECT t.tree, 100 + h.level, h.i, h.h FROM high h, (SELECT DISTINCT tree FROM tops) t WHERE h.size > 1),
steps AS (SELECT p.tree, p.pos, n.level, p.pos // (8 ** n.level)::BIGINT AS i FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE level < 100) n ON p.tree = n.tree
  UNION ALL SELECT p.tree, p.pos, n.level, t.place // (8 ** (n.level - 100))::BIGINT FROM placed p JOIN tops t ON p.tree = t.tree
            JOIN (SELECT DISTINCT tree, level FROM nodes WHERE level >= 100) n ON p.tree = n.tree),
sides AS (SELECT s.tree, s.pos, s.level, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < s.i), '') AS l, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > s.i), '') AS r
          FROM steps s JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.i // 8 = s.i // 8 GROUP BY s.tree, s.pos, s.level),
ways AS (SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY level) AS w, string_agg(l || r, '' ORDER BY level) AS way FROM sides GROUP BY tree, pos),
folded AS (SELECT p.*, w.way, list_reduce(list_prepend({{'l': CASE WHEN p.tampered THEN p.changed ELSE p.leaf END, 'r': ''}}, coalesce(w.w, [])),
           lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM placed p LEFT JOIN ways w ON p.tree = w.tree AND p.pos = w.pos)
SELECT f.doc_id, f.leaf, t.subroot, r.h AS root, sha256(coalesce(f.way, '')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM folded f JOIN tops t ON f.tree = t.tree, (SELECT h FROM high WHERE size = 1) r"""


def source_audit(table: str = "documents", min_docs: int = 10, top: int = 10) -> str:
    def share(n: str, total: str, kept: str) -> str:
        return f"1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {kept})"

    def f(p: str, q: str) -> str:
        return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

    words = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH base AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {table}),
used AS (SELECT row, lang, source, w, count(*) AS n FROM (SELECT row, lang, source, unnest({words}) AS w FROM base) GROUP BY row, lang, source, w),
vocab AS (SELECT lang, w, sum(n) AS n FROM used GROUP BY lang, w HAVING count(*) >= {min_docs}),
langs AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM vocab GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM base),
cell AS (SELECT lang, source, w, sum(n) AS n FROM used SEMI JOIN vocab USING (lang, w) GROUP BY lang, source, w),
total AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM grp g LEFT JOIN cell c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, v.w, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 't.total', 'l.kept')} AS p, {share('v.n', 'l.total', 'l.kept')} AS q
      FROM total t JOIN vocab v USING (lang) JOIN langs l USING (lang) LEFT JOIN cell c ON c.lang = t.lang AND c.source = t.source AND c.w = v.w),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum({f('x.p', 'y.p')}) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.w = y.w AND x.source <> y.source
                     GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, w AS item, {f('p', 'q')} AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= {top}"""
