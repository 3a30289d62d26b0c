"""JSON paths, cursors and payload checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Default payload limits.
MAX_DEPTH = 64
MAX_TOKENS = 5_000_000


def json_key(name: str) -> str:
    """The path step for one object field."""
    quote = '"' if "'" in name else "'"
    return f"[{quote}{name}{quote}]"


def json_path(document: Column, path: str) -> Column:
    """The VARIANT at a dotted path of a VARIANT; '' is the whole document.

    A numeric segment indexes an array, or names a field of an object. A path
    that does not exist gives null.
    """
    node = document
    if path == "":
        return node
    for segment in path.split("."):
        field = F.try_variant_get(node, "$" + json_key(segment), "variant")
        if segment.isdigit():
            node = F.coalesce(F.try_variant_get(node, f"$[{int(segment)}]", "variant"), field)
        else:
            node = field
    return node


def is_json_null(node: Column) -> Column:
    """True for a missing value and for a JSON null."""
    return node.isNull() | F.is_variant_null(node)


def is_json_array(node: Column) -> Column:
    # A typed get looks at the value's own kind; a schema would walk all of it.
    return F.try_variant_get(node, "$", "array<variant>").isNotNull()


def is_json_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def json_array_size(node: Column) -> Column:
    """Number of items of a JSON array, 0 for anything else."""
    items = F.try_variant_get(node, "$", "array<variant>")
    return F.when(items.isNotNull(), F.size(items)).otherwise(0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain_number(text: Column) -> Column:
    """A number's text without exponent and without zeros at either end, exact whatever its size."""
    shape = r"^(-?)([0-9]+)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"

    def part(t: Column, group: int) -> Column:
        return F.regexp_extract(t, shape, group)

    def spread(t: Column) -> Column:
        """The digits with enough zeros on both sides, and the place of the point in them."""
        whole, rest = part(t, 2), part(t, 3)
        power = F.coalesce(F.nullif(part(t, 4), F.lit("")).cast("int"), F.lit(0))
        point = F.length(whole) + power
        before = F.greatest(-point, F.lit(0)) + 1
        after = F.greatest(power - F.length(rest), F.lit(0)) + 1
        digits = F.concat(F.repeat(F.lit("0"), before), whole, rest, F.repeat(F.lit("0"), after))
        return F.struct(digits.alias("digits"), (point + before).alias("at"))

    def trimmed(s: Column) -> Column:
        left = F.ltrim(F.substr(s["digits"], F.lit(1), s["at"]), F.lit("0"))
        right = F.rtrim(F.substr(s["digits"], s["at"] + 1), F.lit("0"))
        return F.concat(F.when(left == "", "0").otherwise(left), F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))

    return bound(text, lambda t: F.when(t.rlike(shape), F.concat(part(t, 1), bound(spread(t), trimmed))).otherwise(t))


def cursor_text(node: Column) -> Column:
    """A JSON scalar as a cursor: text as is, numbers without exponent, true/false.

    Null for an empty string and for anything that is no scalar.
    """

    def scalar(n: Column) -> Column:
        kind, text = F.schema_of_variant(n), F.try_variant_get(n, "$", "string")
        return (
            F.when(kind == "STRING", F.nullif(text, F.lit("")))
            .when(kind.isin("BOOLEAN", "BIGINT"), text)
            .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), plain_number(text))
        )

    # Only a scalar's schema is asked for, which is no walk through a document.
    return bound(node, lambda n: F.when(~is_json_array(n) & ~is_json_object(n), scalar(n)))


def _structure(body: Column) -> Column:
    """A JSON text with every string literal replaced by one quote mark."""
    unescaped = F.regexp_replace(body, r"\\.", "")
    return F.regexp_replace(unescaped, r'"[^"]*"', '"')


def json_depth(body: Column) -> Column:
    """Deepest nesting of brackets outside string literals."""
    brackets = F.regexp_replace(_structure(body), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest"))

    def step(acc: Column, bracket: Column) -> Column:
        opening = bracket.isin("{", "[")
        now = acc["now"] + F.when(opening, 1).when(bracket == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["deepest"], now).alias("deepest"))

    return F.aggregate(F.split(brackets, ""), start, step)["deepest"]


def json_tokens(body: Column) -> Column:
    """Number of JSON tokens: brackets, keys and scalars."""
    return F.regexp_count(_structure(body), F.lit(r'[\[\]{}"]|[-+.0-9A-Za-z]+'))


def is_json(body: Column) -> Column:
    """Whether a text is exactly one JSON value.

    The parser stops after the first value, so the text is tried inside an
    array and inside an object: trailing data breaks at least one of them.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    single = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    return F.coalesce(single & in_object.isNotNull(), F.lit(False))


def bounded_json_verdict(body: Column, max_depth: int = MAX_DEPTH, max_tokens: int = MAX_TOKENS) -> Column:
    """Null for an acceptable payload, else why it is refused."""
    # Exact depth and token counts are taken only where cheap upper bounds allow
    # a breach: the brackets of the text, and its length.
    may_be_deep = F.regexp_count(body, F.lit(r"[\[{]")) > max_depth
    may_be_long = F.octet_length(body) > max_tokens
    return (
        F.when(body.isNull(), F.lit("empty payload"))
        .when(may_be_deep & (json_depth(body) > max_depth), F.lit(f"json exceeds the maximum depth of {max_depth}"))
        .when(may_be_long & (json_tokens(body) > max_tokens), F.lit(f"json exceeds the {max_tokens} token limit"))
        .when(~is_json(body), F.lit("invalid json"))
    )
