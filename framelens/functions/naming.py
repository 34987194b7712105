"""Facts that file names and paths carry."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from framelens.config import LABELS, MODALITIES

#: Scheme and authority of a path, such as ``file:///`` or ``hdfs://host:port/``.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"


def label_of(name: Column) -> Column:
    """Ordered name parts and the label each one means."""
    low = F.lower(name)
    rules = [(label, label) for label in LABELS] + [("sleep", "drowsiness"), ("uyku", "drowsiness"), ("dikkat", "distraction")]
    out = None
    for part, label in rules:
        hit = low.contains(part)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("uploaded")


def modality_of(name: Column) -> Column:
    """Any ``ir`` in the name means IR, also inside a word."""
    return F.when(F.lower(name).contains("ir"), "IR").otherwise("RGB")


def source_group_of(stem: Column) -> Column:
    low = F.lower(stem)
    return (F.when(low.startswith("distraction"), "distraction").when(low.startswith("drowsiness"), "drowsiness")
            .otherwise("unknown"))


def stream_keys(path: Column, root: str, suffix: str = "") -> dict[str, Column]:
    """Label, modality, stem, relative path and error of ``root/label/modality/.../name.ext``."""
    plain = re.sub(_SCHEME, "/", root).strip("/")
    relative = F.regexp_replace(F.regexp_replace(path, _SCHEME, "/"), "^/*" + _literal(plain) + "/*", "")
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    if suffix:
        stem = F.regexp_replace(stem, _literal(suffix), "")
    label, modality = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    error = (F.when(F.size(parts) < 3, "unexpected path structure")
             .when(~label.isin(*LABELS), "unknown label").when(~modality.isin(*MODALITIES), "unknown modality"))
    return {"relative_path": relative, "label": label, "modality": modality, "file_stem": stem, "path_error": error}


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E" if text else ""
