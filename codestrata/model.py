"""Schemas of the tables that operators exchange, and the keys by which subjects are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBJECTS = "subject_key string, subject_type string, namespace string, type string, member string, file string, line int, callable_kind string, class_key string, decl_key string"
METRICS = "subject_key string, level string, metric string, value double"
ENTRIES = "subject_key string, file string, kind string, line int, extra map<string,string>"
EDGES = "project string, src_decl string, src_class string, src_ns string, dst_class string, dst_ns string, dep_type string, file string, line int"
DIRECTIVES = "directive_id bigint, file string, line int, end_line int, kind string, selector string, subject_key string, warning double, error double"
FINDINGS = "channel string, subject_key string, subject_type string, namespace string, file string, line int, severity string, value double, threshold double, occ_key string, dep_target string, dep_type string, minutes int"
BASELINE = "identity_key string, channel string, magnitudes array<double>, count bigint"
LEVELS = ("callable", "class", "file", "namespace", "project")

# fixed values: the forms of a subject's key
FORMS = {"file": "file:{file}", "project": "project:", "namespace": "ns:{namespace}", "class": "class:{class}", "method": "callable:{class}::{member}", "function": "func:{namespace}::{member}"}


def canonical(subject_type: Column, namespace: Column, type_: Column, member: Column, file: Column) -> Column:
    """The key of a subject; parts that a form doesn't use are ignored, missing ones count as empty."""
    empty = F.lit("")
    space = F.coalesce(namespace, empty)
    name = F.when(space == "", F.coalesce(type_, empty)).otherwise(F.concat_ws("\\", space, type_))
    return (
        F.when(subject_type == "file", F.concat(F.lit("file:"), F.coalesce(file, empty))).when(subject_type == "project", "project:")
        .when(subject_type == "namespace", F.concat(F.lit("ns:"), space)).when(subject_type == "class", F.concat(F.lit("class:"), name))
        .when(subject_type == "method", F.concat(F.lit("callable:"), name, F.lit("::"), F.coalesce(member, empty)))
        .when(subject_type == "function", F.concat(F.lit("func:"), space, F.lit("::"), F.coalesce(member, empty)))
    )


def declaration(key: Column, file: Column, ordinal: Column) -> Column:
    """The key of one of several declarations of a name: `declaration:<key>@<file>`, with `#n` from the second on."""
    return F.concat(F.lit("declaration:"), key, F.lit("@"), file, F.when(ordinal > 1, F.concat(F.lit("#"), ordinal.cast("string"))).otherwise(""))


def occurrence_key(**parts: Column) -> Column:
    """16 hex digits that stand for named details of a finding, in the order of the names."""
    return F.substring(F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256), 1, 16)
