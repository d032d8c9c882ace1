"""The few functions that Spark SQL and DuckDB spell differently."""

from __future__ import annotations

from keepsake.functions.ids import DEFAULT_IDS, HEX_DIGITS, VARIANT_DIGITS


def splice(digest: str) -> str:
    """UUIDv5 hex digits out of a SHA-1 hex digest."""
    return (
        f"(substr({digest},1,12) || '5' || substr({digest},14,3) || "
        f"translate(substr({digest},17,1),'{HEX_DIGITS}','{VARIANT_DIGITS}') || substr({digest},18,15))"
    )


class Duck:
    def table(self, name: str) -> str:
        return name

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def octets(self, text: str) -> str:
        return f"octet_length(encode({text}))"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def iso(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

    def json_string(self, text: str) -> str:
        return f"CAST(to_json({text}) AS VARCHAR)"

    def uuid(self, name: str) -> str:
        return splice(f"sha1(from_hex('{DEFAULT_IDS.namespace.hex}') || encode({name}))")


class Spark:
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def octets(self, text: str) -> str:
        return f"CAST(octet_length({text}) AS BIGINT)"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")"

    def json_string(self, text: str) -> str:
        document = f"to_json(named_struct('t', {text}))"
        return f"substr({document}, 6, length({document}) - 6)"

    def uuid(self, name: str) -> str:
        return splice(f"sha1(concat(unhex('{DEFAULT_IDS.namespace.hex}'), encode({name}, 'UTF-8')))")


def object_id(q, source: str, source_id: str) -> str:
    return f"('{DEFAULT_IDS.prefix}_obj_' || {q.uuid(f'''('object:' || {source} || ':' || {source_id})''')})"


def blob_id(digest: str) -> str:
    return f"('{DEFAULT_IDS.prefix}_blob_' || {digest})"
