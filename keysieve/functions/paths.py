"""What a file path says about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import rlike_any


def _forward(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def file_name(path: Column) -> Column:
    """Last path component in lower case; trailing slashes do not count."""
    return F.lower(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1))


def suffix(path: Column) -> Column:
    """Last dotted part of the name, empty for dot files such as ``.env``."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    name, ext = file_name(path), suffix(path)
    return (
        F.when(ext == ".py", F.lit("python"))
        .when(name.isin(*C.CONFIG_NAMES) | ext.isin(*C.CONFIG_SUFFIXES), F.lit("config"))
        .when(ext.isin(*C.JAVASCRIPT_SUFFIXES), F.lit("javascript"))
        .when(ext.isin(*C.JVM_SUFFIXES), F.lit("jvm"))
        .when(ext.isin(*C.OTHER_CODE_SUFFIXES), F.lit("tree_sitter_candidate"))
        .when(ext.isin(*C.DOCUMENT_SUFFIXES), F.lit("documentation"))
        .otherwise(F.lit("plain_text"))
    )


def grammar(path: Column) -> Column:
    """Grammar name for a code suffix, or null."""
    ext = suffix(path)
    out = F.lit(None).cast("string")
    for known, name in C.GRAMMARS.items():
        out = F.when(ext == known, F.lit(name)).otherwise(out)
    return out


def is_doc_or_test(path: Column) -> Column:
    return rlike_any(_forward(path), C.DOC_OR_TEST_PATH_MARKERS)


def is_template_file(path: Column) -> Column:
    return rlike_any(F.substring_index(_forward(path), "/", -1), C.TEMPLATE_NAME_MARKERS)


def raw_url(url: Column) -> Column:
    """Raw-content address of a file page."""
    host = F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com"))
    return F.replace(host, F.lit("/blob/"), F.lit("/"))
