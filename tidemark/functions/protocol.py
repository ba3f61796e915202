"""Commands, requests and command lines as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT

#: Fixed value: where keys live.
PREFIX = "/api/kv/"


def encode_command(op: Column, key: Column, value: Column, compat: str | None = None) -> Column:
    """A command as JSON, its value in base64. ``compat='empty_is_delete'`` leaves an empty value out, as a delete does."""
    v = F.base64(F.encode(value, "UTF-8"))
    if compat == "empty_is_delete":
        v = F.when(F.octet_length(value) > 0, v)
    return F.to_json(F.struct(op.cast("int").alias("type"), key.alias("key"), F.when(op == PUT, v).alias("value")))


def decode_command(text: Column, compat: str | None = None) -> Column:
    """op, key, value of a command; a null struct if it is no command. With compat, a put without a value is a delete."""
    c = F.from_json(text, "type int, key string, value string")
    value = F.decode(F.unbase64(c["value"]), "UTF-8")
    op = F.when((c["type"] == PUT) & c["value"].isNull(), F.lit(DELETE)).otherwise(c["type"]) if compat == "empty_is_delete" else c["type"]
    put = value if compat else F.coalesce(value, F.lit(""))
    return F.when(c["type"].isin(PUT, DELETE), F.struct(op.alias("op"), c["key"].alias("key"), F.when(op == PUT, put).alias("value")))


def path_key(path: Column) -> Column:
    """The key of a request path; it may hold slashes."""
    return F.when(F.startswith(path, F.lit(PREFIX)), F.substring(path, F.lit(len(PREFIX) + 1), F.char_length(path)))


def body_value(body: Column) -> tuple[Column, Column]:
    """(is the body acceptable, its value): a JSON object whose value, if there is one, is a string or null; or null alone."""
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(v)
    inner = F.schema_of_variant(F.try_variant_get(v, "$.value", "variant"))
    is_object = F.startswith(kind, F.lit("OBJECT"))
    ok = v.isNotNull() & ((is_object & (inner.isNull() | inner.isin("STRING", "VOID", "NULL"))) | kind.isin("VOID", "NULL"))
    return F.coalesce(ok, F.lit(False)), F.coalesce(F.when(is_object, F.try_variant_get(v, "$.value", "string")), F.lit(""))


def status_code(method: Column, key: Column, found: Column, body_ok: Column, is_leader: Column, engine_ok: Column | None = None) -> Column:
    """The answer's code: empty key 400; GET 500, 404 or 200; PUT 400 before 503; DELETE 503; other methods 405."""
    good = engine_ok if engine_ok is not None else F.lit(True)
    return (
        F.when(F.coalesce(key, F.lit("")) == "", 400)
        .when(method == "GET", F.when(~good, 500).when(found, 200).otherwise(404))
        .when(method == "PUT", F.when(~body_ok, 400).when(~is_leader, 503).otherwise(200))
        .when(method == "DELETE", F.when(~is_leader, 503).otherwise(200))
        .otherwise(405)
    )


def parse_line(lines: DataFrame, col: str = "line") -> DataFrame:
    """command, key, value and usage_ok of command lines: trimmed, cut at single spaces into three parts at most."""
    parts = F.split(F.trim(F.col(col)), " ", 3)
    command = F.lower(F.element_at(parts, 1))
    command = F.when(command == "delete", "del").when(command == "quit", "exit").otherwise(command)
    key, value = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    ok = F.when(command == "put", value.isNotNull()).when(command.isin("get", "del"), key.isNotNull()).otherwise(command.isin("status", "help", "exit"))
    return lines.select("*", command.alias("command"), key.alias("key"), value.alias("value"), ok.alias("usage_ok"))
