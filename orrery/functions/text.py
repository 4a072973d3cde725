r"""Text and scalar functions as Column expressions (X1-X31). All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the range of CJK characters that count as letters.
CJK = "一-鿿"


def digest(*columns: Column) -> Column:
    """sha256: and the hash of the JSON of a struct whose fields are given in order."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns)), 256))


def slug(c: Column) -> Column:
    """Lower case, other characters to _, collapsed, stripped."""
    kept = F.regexp_replace(F.lower(c), f"[^a-z0-9_\\-{CJK} ]+", "_")
    return F.regexp_replace(F.regexp_replace(kept, "[_ ]+", "_"), "^_+|_+$", "")


def tokens(c: Column) -> Column:
    """Words of [a-z0-9_-], or single CJK characters, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([a-z0-9_-]+|[{CJK}])"), 1)


def mentions(text: Column, label: str) -> Column:
    """An ASCII label must stand alone, another may stand anywhere."""
    low = label.lower()
    if low.isascii():
        import re

        return F.lower(text).rlike(f"(?<![a-z0-9_]){re.escape(low)}(?![a-z0-9_])")
    return F.lower(text).contains(low)


def entity_candidates(c: Column, stop: tuple[str, ...]) -> Column:
    """Words of three letters and more that are no stop words, and CJK runs with their 2- to 4-grams, longest first."""
    words = F.filter(F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z0-9_-]{2,})"), 1), lambda w: ~F.lower(w).isin(*stop))
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}]{{2,}})"), 1)

    def grams(n: int) -> Column:
        cut = F.transform(runs, lambda r: F.when(F.length(r) > n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - n + 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
        return F.flatten(cut)

    every = F.array_distinct(F.concat(words, runs, grams(2), grams(3), grams(4)))
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, 1).when(a > b, -1).otherwise(0)
    return F.array_sort(every, order)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """X7 over arrays of distinct items."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text has none."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1))
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n)))))


def instant(c: Column) -> Column:
    """An ISO instant, which must carry a zone, as UTC; null where it has none."""
    return F.when(c.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), F.to_timestamp(c))


def sampled_fingerprint(c: Column, whole_up_to: int = 1 << 20) -> Column:
    """Hash of small contents; of large ones, of head (4 KB), middle (1 KB), tail (4 KB) and size."""
    n = F.octet_length(c)
    parts = F.concat(F.substring(c, F.lit(1), F.lit(4096)), F.substring(c, (F.floor(n / 2) + 1).cast("int"), F.lit(1024)), F.substring(c, F.lit(-4096), F.lit(4096)), n.cast("string").cast("binary"))
    return F.when(n <= whole_up_to, F.sha2(c, 256)).otherwise(F.sha2(parts, 256))


def front_matter(c: Column) -> Column:
    """Key: value lines between the first two --- lines, as a map."""
    block = F.regexp_extract(c, r"(?s)^---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    key = lambda x: F.trim(F.regexp_extract(x, r"^\s*([\w-]+)\s*:", 1))
    value = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^\s*[\w-]+\s*:(.*)$", 1), "^\\s*[\"']|[\"']\\s*$", ""))
    # The last of equal keys counts.
    names = F.transform(lines, key)
    last = F.filter(F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), value(x).alias("v"), i.alias("i"))), lambda s: F.size(F.filter(F.slice(names, s["i"] + 2, F.size(names)), lambda k: k == s["k"])) == 0)
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"])))


def normalise_link(c: Column) -> Column:
    """X11: [[a|b]] to a, no anchor, '.' and '..' resolved, no leading slash."""
    target = F.regexp_replace(F.regexp_replace(c, r"^\[\[([^|\]]*).*\]\]$", "$1"), "#.*$", "")
    parts = F.filter(F.split(F.trim(target), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    walked = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def concepts(c: Column) -> Column:
    """Back-ticked, bold, italic, CamelCase, headings and 'Term (' of 3 to 99 characters, sorted."""
    patterns = [r"`([^`\n]+)`", r"\*\*([^*\n]+)\*\*", r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", r"(?<!\w)_([^_\n]+)_(?!\w)", r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b", r"(?m)^#{1,6}\s+(.+)$", r"\b([A-Z][A-Za-z]+) \("]
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), 1) for p in patterns])
    clean = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (F.length(x) > 2) & (F.length(x) < 100))
    return F.sort_array(F.array_distinct(clean))


def code_language(c: Column) -> Column:
    """The first language whose mark is there."""
    rules = [
        ("python", r"(?m)^\s*(def |import |from \w+ import|class \w+.*:)"),
        ("sql", r"(?i)\b(select\b.*\bfrom|insert\s+into|create\s+table)\b"),
        ("java", r"\b(public|private)\s+(static\s+)?(class|void|int|String)\b"),
        ("javascript", r"\b(const|let|var|function)\s+\w+"),
        ("html", r"(?i)<(html|div|body|span)\b"),
    ]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("text")


def sql_tables(c: Column) -> Column:
    """Tables after FROM and JOIN, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b(?:from|join)\s+([\w.]+)"), 1)))


def sql_aliases(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\bas\s+(\w+)"), 1))


def sql_smells(c: Column) -> Column:
    """X15."""
    low = F.lower(c)
    return F.array_compact(
        F.array(
            F.when(low.rlike(r"select\s+\*"), "select_star"),
            F.when(~low.contains("where") & ~low.contains("limit"), "unbounded"),
            F.when(F.regexp_count(low, F.lit(r"\bjoin\b")) > 3, "many_joins"),
        )
    )


def red_lines(c: Column, words: str = "must|never|禁止|必须", most: int = 8) -> Column:
    """Sentences of six characters and more that hold one of some words, at most ``most``."""
    return F.slice(F.filter(F.transform(F.split(c, "[。；.;\n]"), lambda x: F.trim(x)), lambda s: (F.length(s) >= 6) & F.lower(s).rlike(words)), 1, most)


def intent_scores(c: Column, keywords: dict[str, list[str]]) -> Column:
    """Share of each intent's keywords that are in the text, normalised to sum to one (a map)."""
    low = F.lower(c)
    raw = {k: sum((low.contains(w).cast("int") for w in ws), F.lit(0)) / len(ws) for k, ws in sorted(keywords.items())}
    total = reduce(lambda a, b: a + b, raw.values())
    return F.create_map(*[x for k, v in raw.items() for x in (F.lit(k), F.when(total > 0, v / total).otherwise(0.0))])


def route(c: Column, groups: list[tuple[str, str]], fallback: str) -> Column:
    """The first group whose pattern is found."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in groups:
        out = out.when(F.lower(c).rlike(pattern), name)
    return out.otherwise(fallback)


def mapping_relevance(query: Column, key: Column, name: Column, description: Column, alias: Column) -> Column:
    """1.0 for the key, 0.9 name, 0.7 alias, 0.5 description that holds the query; at most 1."""
    q = F.lower(query)
    part = lambda c, w: F.when(F.lower(c).contains(q), w).otherwise(0.0)
    return F.least(F.lit(1.0), part(key, 1.0) + part(name, 0.9) + part(description, 0.5) + part(alias, 0.7))


#: Weights of the fields in the weighted substring search.
FIELD_WEIGHTS = {"display_name": 12.0, "name": 8.0, "tags": 4.0, "description": 3.0, "search_text": 1.0}


def weighted_substrings(words: list[str], fields: dict[str, Column]) -> Column:
    """The weights of all (word, field) hits; 0 unless every word is in some field."""
    hit = {(w, f): F.coalesce(F.lower(c).contains(w.lower()), F.lit(False)) for w in words for f, c in fields.items()}
    every = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [hit[w, f] for f in fields]) for w in words])
    total = reduce(lambda a, b: a + b, [F.when(h, FIELD_WEIGHTS[f]).otherwise(0.0) for (_, f), h in hit.items()])
    return F.when(every, total).otherwise(0.0)


def class_name(c: Column) -> Column:
    """Table name to Pascal case, without tbl_, table_ or t_."""
    return F.replace(F.initcap(F.replace(F.regexp_replace(F.lower(c), "^(tbl_|table_|t_)", ""), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def human_bytes(c: Column) -> Column:
    """X23."""
    out = F.when(c < 1024, F.concat(F.format_number(c.cast("double"), 1), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        below = F.lit(True) if unit == "TB" else c < 1024 ** (i + 1)
        out = out.when(below, F.concat(F.format_number(c / 1024**i, 1), F.lit(f" {unit}")))
    return out


def strip_markup(c: Column) -> Column:
    """Fences, tags, links and emphasis out; white space collapsed."""
    out = c
    for pattern, to in ((r"(?s)```.*?```", " "), (r"<[^>]+>", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`#>|]+", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def improvement_terms(c: Column) -> Column:
    """Quoted words, CamelCase and capitals."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), 1) for p in (r'"([^"\n]{2,40})"', r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([A-Z]{2,})\b")])
    return F.sort_array(F.array_distinct(found))


def path_text(nodes: Column, relations: Column) -> Column:
    """A --r--> B --s--> C."""
    step = F.transform(relations, lambda r, i: F.concat(F.lit(" --"), r, F.lit("--> "), F.element_at(nodes, i + 2)))
    return F.concat(F.element_at(nodes, 1), F.array_join(step, ""))


def pick_label(labels: Column) -> Column:
    """Of an array of (text, lang) the zh one, else one without language, else en, else any."""
    order = F.transform(labels, lambda s: F.struct(F.when(s["lang"] == "zh", 0).when(s["lang"].isNull() | (s["lang"] == ""), 1).when(s["lang"] == "en", 2).otherwise(3).alias("p"), s["text"].alias("text")))
    return F.array_min(order)["text"]


def parse_triplet(c: Column) -> Column:
    """X30: 'A -> r -> B' as a struct, null if it is none."""
    part = lambda i: F.trim(F.regexp_extract(c, r"^(.+?)\s*->\s*(.+?)\s*->\s*(.+)$", i))
    return F.when(c.rlike(r"^.+->.+->.+$"), F.struct(part(1).alias("source"), part(2).alias("relation"), part(3).alias("target")))
