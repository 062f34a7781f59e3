"""Searches and their results: queries, gates, addresses and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import any_in, count_in, is_official, path, query

#: What is asked about a company's names: {n} its names, {d} its domain, {m} its market (fixed values).
TEMPLATES = (
    "{n} exact mattress product models official catalogue {m} site:{d}",
    "{n} site:{d} inurl:products mattress",
    "{n} mattress layers foam density thickness construction specifications",
    "{n} mattress catalogue brochure filetype:pdf",
    "{n} mattress discontinued model archive retailer specification {m}",
    "{n} mattress patent trademark material technology construction",
)
#: Words of an error that money would mend (fixed values).
QUOTA = ("quota", "credit", "insufficient balance", "payment required", "http 402", "plan limit")
#: Parameters that only resize a picture (fixed values).
RESIZING = ("width", "height", "w", "h", "crop")
#: Words of a picture that shows how something is made (fixed values).
TECHNICAL = (
    "layer", "construction", "inside", "cutaway", "cross section", "cross-section", "specification", "technology", "foam", "latex", "spring", "coil",
    "density", "thickness", "firmness", "support", "material", "diagram", "grid",
)
#: Kinds of results that are followed whatever their scores (fixed values).
FOLLOWED = ("catalogue", "patent", "teardown", "archive")


def queries(names: list[str], domain: str, market: str, custom: list[str] | None = None) -> list[str]:
    """Custom queries that are not blank, then the templates, names quoted and joined by OR."""
    quoted = " OR ".join(f'"{n}"' for n in names)
    return [q.strip() for q in custom or [] if q.strip()] + [t.format(n=quoted, d=domain, m=market) for t in TEMPLATES]


def is_kept(url: Column, score: Column, domain: str, least: float = 0.18) -> Column:
    return (score >= least) | is_official(url, domain)


def grounded(likelihood: Column, evidence: Column, kind: Column) -> Column:
    """struct(score, kept) of a result that a model has judged."""
    kept = (likelihood >= 0.58) | (evidence >= 0.62) | F.coalesce(kind.isin(*FOLLOWED), F.lit(False))
    return F.struct((0.6 * likelihood + 0.4 * evidence).alias("score"), F.coalesce(kept, F.lit(False)).alias("kept"))


def is_quota_error(error: Column, service: str) -> Column:
    t = F.lower(error)
    return F.contains(t, F.lit(service.lower())) & any_in(t, QUOTA)


def error_kind(error: Column, service: str) -> Column:
    """What a failed session is told: quota, transport, time limit, broker, or other."""
    t = F.lower(error)
    cut = F.contains(t, F.lit("incompleteread")) | (F.contains(t, F.lit("bytes read")) & F.contains(t, F.lit("more expected"))) | F.contains(t, F.lit("remote end closed connection"))
    return (
        F.when(is_quota_error(error, service), "quota").when(cut, "transport").when(any_in(t, ("soft time limit", "timelimit")), "time_limit")
        .when(F.contains(t, F.lit("connection refused")) & F.contains(t, F.lit("redis")), "broker").otherwise("other")
    )


def official_origin(value: Column) -> Column:
    """Scheme and host of a company's site, https where none is stated; null for what is no http address."""
    t = F.trim(value)
    whole = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    return F.nullif(F.regexp_extract(whole, r"^(https?://[^/?#:@]+(?::[0-9]+)?)(?:[/?#]|$)", 1), F.lit(""))


def original_image(url: Column) -> Column:
    """A picture's address without the size that a content network adds to its name, and without resizing parameters."""
    size = r"_(?:[0-9]+x[0-9]*|x[0-9]+)(?:_crop_[^./?]+)?"
    clean = F.regexp_replace(path(url), rf"(?i){size}(?=[.][A-Za-z0-9]{{2,5}}$)", "")
    pairs = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*RESIZING))
    q = F.array_join(pairs, "&")
    return F.concat(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*", 0), clean, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)), F.regexp_extract(url, "#.*$", 0))


def extension(content_type: Column, url: Column) -> Column:
    """Ending of a stored file: by its type, else by its address if short."""
    table = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "application/pdf": ".pdf", "text/html": ".html", "application/json": ".json", "text/plain": ".txt", "text/markdown": ".md", "application/xml": ".xml", "text/xml": ".xml"}
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))))
    named = F.regexp_extract(path(url), r"[^/.][^/]*?([.][^/.]{1,9})$", 1)
    return F.coalesce(known, named)


def technical_score(text: Column) -> Column:
    return F.least(F.lit(0.45), count_in(F.lower(text), TECHNICAL) * 0.055)


def vision_priority(base: Column, url: Column, alt: Column, ocr: Column, is_page: Column, width: Column, height: Column) -> Column:
    """How soon a picture is looked at, from 0 to 1."""
    text = F.concat_ws(" ", url, F.coalesce(alt, F.lit("")), F.coalesce(ocr, F.lit("")))
    sized = (width > 0) & (height > 0)
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = base + technical_score(text) + add(is_page, 0.18) + add(sized & (width >= 1200) & (height >= 700), 0.10) - add(sized & ((width <= 300) | (height <= 180)), 0.28)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - add(any_in(F.lower(text), ("bedroom", "lifestyle", "banner", "hero")), 0.15)))


def markdown_images(text: Column) -> Column:
    """array<struct(alt, url)> of a markdown text's pictures."""
    pattern = r"!\[([^\]]*)\]\((https?://[^\s)]+)"
    alts, urls_ = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.zip_with(alts, urls_, lambda a, u: F.struct(a.alias("alt"), u.alias("url")))


def json_text(answer: Column) -> Column:
    """The JSON in a model's answer: within a fence, else from the first brace to the last; null without any."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    is_json = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    bare = lambda c: F.nullif(F.trim(c, F.lit(" \t\r\n")), F.lit(""))
    return F.coalesce(is_json(bare(fenced)), is_json(bare(answer)), is_json(bare(braced)))


def matches_search(words: Column, *columns: Column) -> Column:
    """Whether a table's row has a text in any of its columns, in any case."""
    return F.contains(F.lower(F.concat_ws(" ", *(c.cast("string") for c in columns))), F.lower(words))


def shown(c: Column) -> Column:
    """A cell as text: empty for null, containers as JSON."""
    return F.coalesce(c.cast("string"), F.lit(""))
