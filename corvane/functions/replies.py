"""Replies of language models: text blocks, judge verdicts, retry decisions; native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_text(content: str) -> Column:
    """Text of a message whose content column is a JSON string, a JSON list of strings and typed blocks, or else a plain string; objects have none."""
    v = f"try_parse_json({content})"
    blocks = f"try_variant_get({v}, '$', 'array<variant>')"
    kind = "try_variant_get(b, '$.type', 'string')"
    one = f"case when schema_of_variant(b) = 'STRING' then cast(b as string) when schema_of_variant(b) like 'OBJECT%' and {kind} = 'text' then coalesce(try_variant_get(b, '$.text', 'string'), '') end"
    joined = f"array_join(transform({blocks}, b -> {one}), '')"
    return F.expr(f"case when schema_of_variant({v}) = 'STRING' then cast({v} as string) when {blocks} is not null then {joined} when schema_of_variant({v}) like 'OBJECT%' then '' else coalesce({content}, '') end")


def judge_verdict(raw: str) -> Column:
    """struct(valid, faithful, sufficient, issues) of a judge's reply; anything but an object with a boolean `faithful` is invalid."""
    trimmed = rf"regexp_replace({raw}, r'^\s+|\s+$', '')"
    clean = rf"regexp_replace({trimmed}, r'(?md)^```(?:json)?|```$', '')"
    v = rf"coalesce(try_parse_json({clean}), try_parse_json(regexp_extract({clean}, r'(?s)(\{{.*\}})', 1)))"
    kind = lambda path: f"schema_of_variant(try_variant_get({v}, '$.{path}', 'variant'))"
    valid = f"coalesce({kind('faithful')} = 'BOOLEAN' and coalesce({kind('sufficient_context')} = 'BOOLEAN', true), false)"
    flag = lambda path, default: f"coalesce(try_variant_get({v}, '$.{path}', 'boolean'), {default})"
    return F.expr(f"named_struct('valid', {valid}, 'faithful', {valid} and {flag('faithful', 'false')}, 'sufficient', {valid} and {flag('sufficient_context', 'true')}, 'issues', coalesce(try_variant_get({v}, '$.issues', 'string'), ''))")


def retry_decision(error: str, attempt: str, attempts: int = 4) -> Column:
    """struct(action, delay): 'raise' what is no rate limit, 'give_up' when waiting can't help, else 'wait' delay seconds."""
    limited = f"({error} like '%429%' or {error} like '%RESOURCE_EXHAUSTED%')"
    daily = f"({error} like '%PerDay%' or lower({error}) like '%requests_per_day%')"
    told = rf"""regexp_extract({error}, r"retryDelay['\x22]?:\s*['\x22]?(\d+(?:\.\d+)?)s", 1)"""
    delay = f"coalesce(cast(nullif({told}, '') as double), pow(2, {attempt}))"
    return F.expr(f"named_struct('action', case when not {limited} then 'raise' when {daily} or {delay} > 120 or {attempt} >= {attempts - 1} then 'give_up' else 'wait' end, 'delay', {delay})")
