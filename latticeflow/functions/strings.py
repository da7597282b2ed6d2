"""File-name and code-name expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes of the image header's fields.
DATATYPES = {0: "UNKNOWN", 1: "BINARY", 2: "UINT8", 4: "INT16", 8: "INT32", 16: "FLOAT32", 32: "COMPLEX64", 64: "FLOAT64", 128: "RGB24", 256: "INT8", 512: "UINT16", 768: "UINT32", 1024: "INT64", 1280: "UINT64", 1536: "FLOAT128", 1792: "COMPLEX128", 2048: "COMPLEX256", 2304: "RGBA32"}
UNITS = {1: "m", 2: "mm", 3: "um", 8: "s", 16: "ms", 24: "us", 32: "Hz", 40: "ppm", 48: "rad/s"}
TRANSFORMS = {1: "Scanner Anat", 2: "Aligned Anat", 3: "Talairach", 4: "MNI_152"}
SLICE_ORDERS = {1: "sequential_increasing", 2: "sequential_decreasing", 3: "alternating_increasing", 4: "alternating_decreasing", 5: "alternating_increasing_2", 6: "alternating_decreasing_2"}
ORIENTATIONS = {1: "Left-to-Right", 2: "Right-to-Left", 3: "Posterior-to-Anterior", 4: "Anterior-to-Posterior", 5: "Inferior-to-Superior", 6: "Superior-to-Inferior"}
INTENTS = {
    2: "Correlation statistic", 3: "T-statistic", 4: "F-statistic", 5: "Z-score", 6: "Chi-squared distribution", 7: "Beta distribution", 8: "Binomial distribution", 9: "Gamma distribution", 10: "Poisson distribution",
    11: "Normal distribution", 12: "F-statistic noncentral", 13: "Chi-squared noncentral", 14: "Logistic distribution", 15: "Laplace distribution", 16: "Uniform distribition", 17: "T-statistic noncentral", 18: "Weibull distribution",
    19: "Chi distribution", 20: "Inverse Gaussian distribution", 21: "Extreme Value distribution", 22: "P-value", 23: "Log P-value", 24: "Log10 P-value", 1001: "Estimate", 1002: "Label index", 1003: "NeuroNames index",
    1004: "General matrix", 1005: "Symmetric matrix", 1006: "Displacement vector", 1007: "Vector", 1008: "Pointset", 1009: "Triangle", 1010: "Quaternion", 1011: "Dimensionless number",
}


def coded(code: Column, table: dict[int, str], other: str = "Unknown") -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit(other))


def datatype_name(code: Column) -> Column:
    return coded(code, DATATYPES, "**ILLEGAL**")


def datatype_code(name: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in DATATYPES.items()))
    return F.coalesce(F.try_element_at(names, F.upper(F.regexp_replace(name, "^(NIFTI|DT)_?(TYPE_)?", ""))), F.lit(0))


def extension(name: Column) -> Column:
    """From the last dot on, '' without one."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def without_extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.substr(name, F.lit(1), F.length(name) - F.length(extension(name)))).otherwise(name)


def change_extension(name: Column, new: str) -> Column:
    return F.concat(without_extension(name), F.lit(new))


def before_first_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def split_any(text: Column, separators: str) -> Column:
    """Split at any of the separators; empty parts inside stay, those at the end go."""
    marks = "[" + "".join(f"\\{c}" for c in separators) + "]"
    return F.split(F.regexp_replace(text, marks + "+$", ""), marks)


def image_extension(name: Column) -> Column:
    """.nii, .hdr, .img or .nia, with .gz if it follows (not after .nia); null without."""
    return F.nullif(F.regexp_extract(name, r"(\.(?:nii|hdr|img)(?:\.gz)?|\.nia|\.(?:NII|HDR|IMG)(?:\.GZ)?|\.NIA)$", 1), F.lit(""))


def is_gzip(name: Column) -> Column:
    return F.lower(name).endswith(".gz")


def image_base_name(name: Column) -> Column:
    ext = image_extension(name)
    return F.when(ext.isNotNull(), F.substr(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\r", "&#x0d;"), ("\n", "&#x0a;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_xml(text: Column) -> Column:
    for a, b in (("&#x0a;", "\n"), ("&#x0d;", "\r"), ("&apos;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slice_numbers(text: Column) -> Column:
    """`a-b,c` as a sorted array of distinct integers."""
    parts = F.transform(F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p.rlike("^[0-9]+(-[0-9]+)?$")), lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(parts)))
