"""Schema sidecars: a table's metadata as JSON beside its export, enough to build the table again."""

from __future__ import annotations

import base64
import json
import struct
from pathlib import PurePosixPath

from strataline.functions import codepages
from strataline.sources import files
from strataline.sources import table_format as tf
from strataline.sources.dbf_source import layout_of

#: The sidecar's format name and version.
FORMAT, VERSION = "strataline-vfp-table-schema", 1


def data_path(root: str, relative: str, suffix: str) -> str:
    return f"{root}/{PurePosixPath(relative).with_suffix('.' + suffix)}"


def sidecar_path(root: str, relative: str) -> str:
    p = PurePosixPath(relative)
    return f"{root}/{p.with_name(p.stem + '_schema.json')}"


def _kind(layout: tf.Layout, f: tf.Field) -> str:
    if layout.is_memo(f):
        return "string" if f.dbf_type == "M" else "base64"
    if layout.is_double(f):
        return "number"
    return {"N": "number", "F": "number", "I": "number", "+": "number", "Y": "decimal-string", "L": "boolean-or-null", "D": "date", "T": "datetime", "@": "datetime", "0": "base64"}.get(f.dbf_type, "string")


def describe(table: files.FoundTable, memo_policy: str = "inline", encoding: str = "auto", errors: str = "strict", known: dict | None = None) -> dict:
    """The sidecar of a table; known is its fingerprint, whose hashes are then not computed again."""
    known = known or {}
    layout = layout_of(table.path, encoding, errors)
    tf.check_supported(layout)
    memo_head = files.read_bytes(table.memo, tf.MEMO_HEADER) if table.memo else None
    next_free, _, block = struct.unpack(">LHH", memo_head[:8]) if memo_head and len(memo_head) >= 8 else (None, None, None)
    size = lambda p: files.at(p)[0].get_file_info(files.at(p)[1]).size
    vfp = layout.version in tf.VFP_VERSIONS
    return {
        "schema_format": FORMAT,
        "schema_version": VERSION,
        "table": table.name,
        "relative_path": table.relative,
        "source": {"filename": PurePosixPath(table.relative).name, "relative_path": table.relative, "size_bytes": size(table.path), "sha256": known.get("dbf_sha256") or files.sha256(table.path)},
        "dbf": {
            "format_family": "Microsoft Visual FoxPro" if vfp else "xBase",
            "version_byte": f"0x{layout.version:02x}",
            "last_update": layout.last_update,
            "record_count_from_header": layout.records,
            "header_length_bytes": layout.header_length,
            "record_length_bytes": layout.record_length,
            "incomplete_transaction": layout.incomplete,
            "encrypted": layout.encrypted,
            "structural_index_flag": layout.table_flags,
            "language_driver": f"0x{layout.language_driver:02x}",
            "encoding": layout.encoding,
            "header_base64": base64.b64encode(layout.header).decode(),
        },
        "text_encoding": {
            "declared_or_detected_encoding": layout.encoding,
            "user_override": None if encoding == "auto" else encoding,
            "decode_errors": errors,
            "fallback_order": codepages.attempts(layout.encoding),
        },
        "memo": {
            "path": PurePosixPath(table.memo).name if table.memo else None,
            "present": table.memo is not None,
            "required": bool(layout.memo_fields),
            "size_bytes": size(table.memo) if table.memo else None,
            "sha256": (known.get("fpt_sha256") or files.sha256(table.memo)) if table.memo else None,
            "header_base64": base64.b64encode(memo_head).decode() if memo_head else None,
            "block_size_bytes": block,
            "next_free_block": next_free,
            "field_names": layout.memo_fields,
            "export_policy": memo_policy,
            "values_in_data_output": memo_policy == "inline",
        },
        "fields": [
            {
                "name": f.name,
                "ordinal": f.ordinal,
                "dbf_type": f.dbf_type,
                "type_name": tf.TYPE_NAMES[f.dbf_type],
                "length": f.length,
                "decimal_count": f.decimals,
                "flags": f.flags,
                "nullable": f.nullable,
                "is_memo": layout.is_memo(f),
                "json_type": _kind(layout, f),
                "descriptor_base64": base64.b64encode(f.descriptor).decode(),
            }
            for f in layout.fields
        ],
    }


def load(path: str) -> dict:
    """A sidecar, if its format and version are known and it has fields; else ValueError."""
    found = json.loads(files.read_bytes(path))
    if not str(found.get("schema_format")).endswith("-vfp-table-schema") or found.get("schema_version") != VERSION or not found.get("fields"):
        raise ValueError(f"not a version {VERSION} sidecar: {path}")
    return found


def layout_from(found: dict) -> tf.Layout:
    """The layout that a sidecar's header bytes hold."""
    return tf.parse_layout(base64.b64decode(found["dbf"]["header_base64"]), found["dbf"]["encoding"], "strict")


def csv_types(found: dict) -> dict[str, str]:
    """Column kinds of a plain CSV: boolean, integer, number or string."""
    def kind(f: dict) -> str:
        if f["json_type"] == "boolean-or-null":
            return "boolean"
        if f["json_type"] == "number":
            return "integer" if not f["decimal_count"] and f["dbf_type"] not in "BFO" else "number"
        return "string"

    return {f["name"]: kind(f) for f in found["fields"]}
