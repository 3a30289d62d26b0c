"""Classify error texts, vendor codes, warnings and limit ratios."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Phrases that decide an error's class; the first class with a hit wins.
ERROR_PHRASES = {
    "auth_failed": (
        "password authentication failed", "authentication failed", "invalid_grant", "invalid api key",
        "unauthorized", " 401",
    ),
    "permission_denied": ("access denied", "forbidden", "permission denied", " 403"),
    "network_unreachable": ("no such host", "connection refused", "network is unreachable", "no route to host"),
    "timeout": ("context deadline exceeded", "i/o timeout", "timed out"),
    "not_found": ("does not exist", "not found", " 404"),
    "rate_limited": ("rate limit", "too many requests", "throttl", " 429"),
    "invalid_config": (
        "is required", "must be a valid", "invalid config", "invalid configuration", "configure authentication",
    ),
}

# Class of the codes each vendor reports.
VENDOR_CODES = {
    "postgres": {
        "28P01": "auth_failed", "28000": "auth_failed", "3D000": "not_found", "42501": "permission_denied",
    },
    "mysql": {
        "1045": "auth_failed", "1049": "not_found", "1044": "permission_denied", "1142": "permission_denied",
    },
    "aws": {
        "AccessDenied": "permission_denied", "AccessDeniedException": "permission_denied",
        "UnauthorizedException": "permission_denied", "InvalidAccessKeyId": "auth_failed",
        "SignatureDoesNotMatch": "auth_failed", "UnrecognizedClientException": "auth_failed",
        "ExpiredToken": "auth_failed", "ExpiredTokenException": "auth_failed",
        "ResourceNotFoundException": "not_found", "NoSuchBucket": "not_found", "NoSuchKey": "not_found",
        "NotFoundException": "not_found", "ThrottlingException": "rate_limited",
        "TooManyRequestsException": "rate_limited", "RequestLimitExceeded": "rate_limited",
    },
    "http": {"401": "auth_failed", "403": "permission_denied", "404": "not_found", "429": "rate_limited"},
}

UNKNOWN = "unknown"


def classify_error(message: Column) -> Column:
    """The class of a free error text."""
    lowered = F.lower(message)
    case = F.when(message.isNull(), F.lit(None).cast("string"))
    for code, phrases in ERROR_PHRASES.items():
        case = case.when(lowered.rlike("|".join(re.escape(p) for p in phrases)), F.lit(code))
    return case.otherwise(F.lit(UNKNOWN))


def classify_code(vendor: Column, code: Column) -> Column:
    """The class of a vendor's own error code, looked up in a constant map."""
    pairs = [
        F.lit(text)
        for vendor_name, codes in VENDOR_CODES.items()
        for code_name, kind in codes.items()
        for text in (f"{vendor_name}:{code_name}", kind)
    ]
    known = F.try_element_at(F.create_map(*pairs), F.concat(F.lower(vendor), F.lit(":"), code))
    return F.coalesce(known, F.lit(UNKNOWN))


# The phrases of warnings and errors, their order, and the kind of trip each stands for.
def warning_trip_kind(warning: Column) -> Column:
    """The limit a warning is about, null for other warnings."""
    w = F.lower(warning)
    return (
        F.when(F.contains(w, F.lit("column cap")), "max_columns")
        .when(F.contains(w, F.lit("cell")) & F.contains(w, F.lit("truncated")), "cell_bytes")
        .when(F.contains(w, F.lit("row cap")) | F.contains(w, F.lit("row count is")), "max_rows")
        .when(F.contains(w, F.lit("response body")), "http_response_body_bytes")
    )


def trip_kinds(warnings: Column) -> Column:
    """The distinct limits a list of warnings is about."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(warnings, warning_trip_kind))))


def error_trip_kind(message: Column) -> Column:
    """The limit an error is about, null for other errors."""
    m = F.lower(message)
    return (
        F.when(F.contains(m, F.lit("maximum depth")), "json_depth")
        .when(F.contains(m, F.lit("token limit")), "json_elements")
        .when(F.contains(m, F.lit("decompression ratio")), "decompress_ratio")
        .when(F.contains(m, F.lit("memory pressure")), "memory_pressure")
        .when(F.contains(m, F.lit("quota")) | F.contains(m, F.lit("rate limit")), "quota")
    )


def soft_limit_bucket(ratio: Column) -> Column:
    """Which soft warning a usage ratio falls under."""
    return F.when(ratio >= 0.95, "0.95").when(ratio >= 0.90, "0.90").otherwise("0.80")
