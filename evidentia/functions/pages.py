"""What a captured document is: its kind, whether it shows a product, and the structured data it holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text
from .urls import any_in, is_detail, is_non_product, path

#: Words of a page that sells, and words of a page that says how a mattress is made (fixed values).
COMMERCE = ("add to cart", "buy now", "sku", "price", "choose size", "select size", "warranty", "product details")
EVIDENCE = ("density", "kg/m", "layer", "foam", "latex", "thickness", "firmness", "construction", "specification", "warranty")
#: Names of files that name no product (fixed values).
NAMELESS = ("index", "product", "products", "catalogue", "catalog")
#: Marks of a page that scripts fill (fixed values).
SHELLS = ("__next", "__nuxt", "id=\"root\"", "id=\"app\"", "data-reactroot", "ng-version")
#: Types of files by their endings, where a server names none (fixed values).
TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif", ".svg": "image/svg+xml", ".pdf": "application/pdf"}


def is_html(content_type: Column, url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))


def is_pdf(content_type: Column, url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")) | F.lower(path(url)).endswith(".pdf")


def repaired_type(content_type: Column, url: Column) -> Column:
    """The stated type without parameters; by the address's ending where it is missing or says nothing."""
    stated = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    table = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    by_name = F.try_element_at(table, F.lower(F.regexp_extract(path(url), r"[.][A-Za-z0-9]+$", 0)))
    return F.when(stated.isin("", "application/octet-stream", "binary/octet-stream"), F.coalesce(by_name, stated)).otherwise(stated)


def body_text(body: Column, content_type: Column) -> Column:
    """A binary body as text, in the charset that its type states; UTF-8 without one or with one that is not known."""
    named = F.upper(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))
    return F.when(named.isin("ISO-8859-1", "LATIN1", "WINDOWS-1252"), F.decode(body, "ISO-8859-1")).when(named.isin("UTF-16", "UTF-16LE", "UTF-16BE"), F.decode(body, "UTF-16")).otherwise(F.decode(body, "UTF-8"))


def needs_rendering(page: Column, text: Column, has_product: Column, thin: int = 800) -> Column:
    """Whether a page is a shell for scripts: a shell's mark, little text, and no structured product."""
    return any_in(F.lower(page), SHELLS) & (F.length(text) < thin) & ~has_product


def looks_like_product(url: Column, text: Column) -> Column:
    """A product's path, and within 20,000 characters the word mattress and a word of commerce."""
    t = F.lower(F.substring(text, 1, 20_000))
    return ~is_non_product(url) & is_detail(F.lower(path(url))) & F.contains(t, F.lit("mattress")) & any_in(t, COMMERCE)


def looks_relevant(url: Column, text: Column, names: tuple[str, ...]) -> Column:
    """A product's page, or within 50,000 characters the word mattress, a name of the company and a word of evidence."""
    t = F.lower(F.substring(text, 1, 50_000))
    known = tuple(n.lower() for n in names if n.strip())
    return looks_like_product(url, text) | (F.contains(t, F.lit("mattress")) & any_in(t, known) & any_in(t, EVIDENCE))


def document_type(url: Column, has_product: Column) -> Column:
    low = F.lower(url)
    listed = F.when(F.contains(low, F.lit("mattress-in-")), "location_page").when(F.contains(low, F.lit("store")), "store_page").when(F.contains(low, F.lit("/blog")), "blog_or_guide").otherwise("collection")
    return F.when(is_non_product(url), listed).when(has_product | is_detail(F.lower(path(url))), "product_detail").when(low.endswith(".pdf"), "catalogue").otherwise("other")


def admitted(structured: Column, product_bearing: Column, confidence: Column, least: float = 0.68) -> Column:
    """Whether a product found on a page is kept: from structured data always, else unless an active recogniser is sure that the page bears none.

    ``product_bearing`` and ``confidence`` are null where no recogniser spoke.
    """
    vetoed = product_bearing.isNotNull() & ~(product_bearing & (confidence >= least))
    return structured | ~F.coalesce(vetoed, F.lit(False))


def name_hint(url: Column) -> Column:
    """A name from an address's last segment, null where it names nothing."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.try_url_decode(path(url)), "/+$", ""), "/"), -1), r"(?<=.)[.][^.]*$", "")
    found = clean_text(F.regexp_replace(last, "[-_]+", " "))
    return F.when((found != "") & ~F.lower(found).isin(*NAMELESS), F.initcap(found))


def meta(page: Column, *names: str) -> Column:
    """The first content that is not blank of the page's meta tags of one of these names, in the page's order; either attribute may come first."""
    tags = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    value = lambda tag, of: F.regexp_extract(tag, rf"""(?is)\b{of}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1) if of else tag
    other = lambda tag, of: F.regexp_extract(tag, rf"""(?is)\b{of}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    whole = lambda tag, of: F.concat(value(tag, of), other(tag, of))
    key = lambda tag: F.lower(F.coalesce(F.nullif(whole(tag, "property"), F.lit("")), whole(tag, "name")))
    fit = F.filter(tags, lambda t: key(t).isin(*(n.lower() for n in names)))
    return F.get(F.filter(F.transform(fit, lambda t: clean_text(whole(t, "content"))), lambda v: v != ""), F.lit(0))


def _field(obj: Column, name: str) -> Column:
    return F.get_json_object(obj, f"$.{name}")


def brand(obj: Column, fallback: Column) -> Column:
    """The brand's name where it is an object, the brand itself where it is a text, else the fallback."""
    raw = _field(obj, "brand")
    named = F.when(raw.startswith("{"), _field(obj, "brand.name")).otherwise(raw)
    return clean_text(F.coalesce(F.nullif(named, F.lit("")), fallback))


def offer(obj: Column) -> Column:
    """struct(price, currency) of the first offer: its price, else its lowest; a price that is no number is null."""
    raw = _field(obj, "offers")
    first = F.when(raw.startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)
    given = lambda k: F.nullif(F.nullif(F.get_json_object(first, f"$.{k}"), F.lit("")), F.lit("0"))
    price = F.replace(F.coalesce(given("price"), given("lowPrice")), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(price.alias("price"), F.nullif(clean_text(F.get_json_object(first, "$.priceCurrency")), F.lit("")).alias("currency"))
