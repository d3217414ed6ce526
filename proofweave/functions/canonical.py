"""Canonical JSON of audit events: sorted keys, no spaces, UTF-8 kept, nulls kept."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the fields an audit event is hashed over
EVENT_FIELDS = (
    "id", "at", "actor", "session_id", "purpose", "case_id", "action", "resource_type", "resource_id", "decision", "detail",
)


@F.pandas_udf(T.StringType())
def _canonical(event: pd.DataFrame) -> pd.Series:
    def one(row) -> str:
        fields = dict(zip(event.columns, row))
        fields = {k: (None if v is None or v is pd.NA else v) for k, v in fields.items()}
        fields["id"] = int(fields["id"])
        fields["detail"] = None if fields["detail"] is None else json.loads(fields["detail"])
        return json.dumps(fields, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))

    rows = zip(*[event[c].tolist() for c in event.columns])
    return pd.Series([one(r) for r in rows], dtype="object")


def canonical_event(**columns: Column) -> Column:
    """Canonical JSON string of an event; ``at`` is a UTC timestamp, ``detail`` a JSON string."""
    at = F.date_format(columns["at"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = {**{f: columns.get(f, F.lit(None)) for f in EVENT_FIELDS}, "at": at}
    return _canonical(F.struct(*[(parts[f].cast("long") if f == "id" else parts[f].cast("string")).alias(f) for f in EVENT_FIELDS]))


def entry_hash(prev_hash: Column, event_json: Column) -> Column:
    return F.sha2(F.concat(prev_hash, event_json), 256)
