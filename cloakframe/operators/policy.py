"""Policies as data: packs, minimization, high-risk combinations, impact scores, roles, erasure."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import lit
from . import anonymize

# Fixed packs: regulation, operators by type, days a mapping and an audit row are kept, what happens to unknown types, whether risky combinations block, whether text is stripped, longest text, what a violation does.
PACKS = {
    "ccpa": ("CCPA", "EMAIL=hash PHONE=mask PERSON=pseudonymize IP_ADDRESS=mask", 0, 365, "log", False, False, None, "alert"),
    "gdpr-analytics": ("GDPR", "EMAIL=hash PHONE=mask PERSON=pseudonymize IP_ADDRESS=mask", 30, 180, "log", False, False, 500000, "alert"),
    "gdpr-article-17": ("GDPR", "", 0, 90, "log", False, True, None, "alert"),
    "gdpr-strict": ("GDPR", "EMAIL=mask PHONE=mask PERSON=replace IBAN=redact CREDIT_CARD=redact SSN=redact ADDRESS=replace IP_ADDRESS=mask", 0, 90, "log", True, True, 1000000, "block,alert"),
    "hipaa": ("HIPAA", "PERSON=replace ADDRESS=replace DATE=mask PHONE=mask EMAIL=mask SSN=redact MEDICAL_RECORD=redact NATIONAL_ID=redact DRIVER_LICENSE=redact VEHICLE_PLATE=mask IP_ADDRESS=mask URL=redact CREDIT_CARD=redact BANK_ACCOUNT=redact TAX_ID=redact", 0, 2555, "anonymize", True, True, None, "block,alert"),
    "lgpd": ("LGPD", "EMAIL=mask PHONE=mask PERSON=replace NATIONAL_ID=redact TAX_ID=redact", 0, 365, "log", True, True, None, "alert"),
    "pci-dss": ("PCI_DSS", "CREDIT_CARD=fpe BANK_ACCOUNT=tokenize PERSON=mask", 0, 365, "log", True, True, None, "block,alert"),
}
# Fixed weights of types in an impact score; others weigh 10.
SENSITIVITY = dict(MEDICAL_RECORD=35, SSN=30, PASSPORT=28, NATIONAL_ID=28, CREDIT_CARD=25, IBAN=22, BANK_ACCOUNT=22, TAX_ID=20, EMAIL=8, PHONE=8, PERSON=12, ADDRESS=14, LOCATION=10, ORGANIZATION=6, IP_ADDRESS=7, CRYPTO_WALLET=15, DRIVER_LICENSE=25)
RISKY = (("MEDICAL_RECORD",), ("CREDIT_CARD", "IBAN", "BANK_ACCOUNT"), ("SSN", "PASSPORT", "NATIONAL_ID", "DRIVER_LICENSE", "TAX_ID"))
ROLE_TYPES = {"viewer": ("EMAIL", "PHONE"), "operator": ("EMAIL", "PHONE", "IP_ADDRESS"), "admin": (), "auditor": ("IP_ADDRESS",)}


PACK_FIELDS = ("regulation", "operators", "mapping_days", "audit_days", "on_unknown", "block_high_risk", "strip_text", "most_chars", "on_violation")


def load_packs(*folders: str) -> dict[str, tuple]:
    """The built-in packs, and those of JSON files in the folders by name, a later one over an earlier; missing fields take the strictest pack's."""
    packs = dict(PACKS)
    for folder in folders:
        for path in sorted(Path(folder).glob("*.json")):
            data = json.loads(path.read_text(encoding="utf-8"))
            name = str(data.pop("name", path.stem)).strip().lower()
            if unknown := set(data) - set(PACK_FIELDS):
                raise ValueError(f"unknown fields {sorted(unknown)} in {path}")
            if isinstance(data.get("operators"), dict):
                data["operators"] = " ".join(f"{k.strip().upper()}={x}" for k, x in data["operators"].items())
            packs[name] = tuple(data.get(f, x) for f, x in zip(PACK_FIELDS, packs.get(name, PACKS["gdpr-strict"]), strict=True))
    return packs


def merged_config(name: str, own: dict | None = None, packs: dict[str, tuple] = PACKS) -> dict:
    """An engine's settings with a policy's on top: its operators and days by type."""
    operators = dict(x.split("=") for x in packs[name][1].split())
    days = packs[name][2]
    return (own or {}) | {"policy_name": name, "policy_regulation": packs[name][0], "entity_operators": operators, "entity_retention_days": dict.fromkeys(operators, days) if days > 0 else {}, "pseudonymization_mapping_days": days}


def response(entities: str, name: str, redacted: tuple[str, ...] = (), packs: dict[str, tuple] = PACKS) -> Column:
    """What an answer shows under a policy: struct (entities, redacted, blocked).

    Texts go if the policy strips them or their type is among ``redacted``; a risky combination blocks the answer if the
    policy says so, and then no entity is shown.
    """
    _, _, _, _, _, blocks, strips, _, violation = packs[name]
    hide = "true" if strips else f"e.entity_type in ({', '.join(lit(t) for t in redacted)})" if redacted else "false"
    groups = " + ".join(f"cast(exists({entities}, e -> e.entity_type in ({', '.join(lit(t) for t in g)})) as int)" for g in RISKY)
    stop = f"({groups} >= 2)" if blocks and "block" in violation.split(",") else "false"
    shown = f"transform({entities}, e -> named_struct('start', e.start, 'end', e.end, 'entity_type', e.entity_type, 'text', if({hide}, '[REDACTED]', e.text), 'score', e.score))"
    kind = "array<struct<start:int,end:int,entity_type:string,text:string,score:double>>"
    return F.expr(f"named_struct('entities', if({stop}, cast(array() as {kind}), {shown}), 'redacted', if({stop}, 0, size(filter({entities}, e -> {hide}))), 'blocked', {stop})")


def registered(subjects: DataFrame, subject: str, name: str, now: Column, packs: dict[str, tuple] = PACKS) -> DataFrame:
    """(subject, mapping_key, expires_at) of subjects whose pseudonyms a policy keeps; none if it keeps them no day, nor without a subject."""
    days = packs[name][2]
    rows = subjects.select(subject).where(F.col(subject).isNotNull() & (F.col(subject).cast("string") != "")).where(F.lit(days > 0)).distinct()
    return rows.select(subject, F.sha2(F.concat_ws("|", F.lit(name), F.col(subject).cast("string"), now.cast("string")), 256).alias("mapping_key"), (now + F.expr(f"interval {days} days")).alias("expires_at"))


def pack_operators(name: str, override: dict[str, str] | None = None) -> dict[str, str]:
    """A pack's operators by type, with the caller's own on top."""
    return dict(x.split("=") for x in PACKS[name][1].split()) | (override or {})


def operator_dimension(spark: SparkSession) -> DataFrame:
    """(policy, entity_type, operator): a table of fixed, small size."""
    return spark.createDataFrame([(p, t, o) for p in PACKS for t, o in pack_operators(p).items()], "policy string, entity_type string, operator string")


def policy_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, *x[:1], *x[2:]) for p, x in PACKS.items()], "policy string, regulation string, mapping_days int, audit_days int, on_unknown string, blocks boolean, strips boolean, most_chars int, on_violation string")


def with_operators(entities: DataFrame, policy: str) -> DataFrame:
    """Entity rows with the policy's operator; types without one are redacted."""
    table = operator_dimension(entities.sparkSession).where(F.col("policy") == policy).drop("policy")
    return entities.join(F.broadcast(table), "entity_type", "left").withColumn("operator", F.coalesce("operator", F.lit("redact")))


def minimized(text: Column, most: int | None = None, strip: bool = True) -> Column:
    """Control characters but line feeds, returns and tabs go, then what is beyond ``most`` characters, then outer space."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "") if strip else text
    return F.regexp_replace(F.left(out, F.lit(most)) if most else out, r"^\s+|\s+$", "")


def high_risk(types: Column) -> Column:
    """Whether two or more groups of risky types are among these."""
    return sum((F.arrays_overlap(types, F.array(*[F.lit(t) for t in g])).cast("int") for g in RISKY), F.lit(0)) >= 2


def impact_scores(spark: SparkSession, processed: DataFrame) -> DataFrame:
    """(policy, score, band) for rows (policy, entity_type): 5, plus each type's weight, plus and minus what the pack says, within 0 and 100."""
    weights = spark.createDataFrame(list(SENSITIVITY.items()), "entity_type string, weight int")
    sums = processed.join(F.broadcast(weights), "entity_type", "left").groupBy("policy").agg(F.sum(F.coalesce("weight", F.lit(10))).alias("sum"))
    packs = policy_dimension(spark).join(sums, "policy", "left")
    raw = F.lit(5) + F.coalesce("sum", F.lit(0)) + F.when(F.col("blocks"), 5).otherwise(0) + F.when(F.col("mapping_days") > 90, 10).otherwise(0) - F.when(F.col("strips"), 8).otherwise(0)
    score = F.least(F.greatest(raw, F.lit(0)), F.lit(100))
    band = F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 40, "moderate").otherwise("low")
    return packs.select("policy", score.cast("long").alias("score"), band.alias("band"))


def visible_to(entities: DataFrame, role: str) -> DataFrame:
    """Entity rows of the types a role may see; no list means all."""
    allowed = ROLE_TYPES[role]
    if not allowed:
        return entities
    types = entities.sparkSession.createDataFrame([(t,) for t in allowed], "entity_type string")
    return entities.join(F.broadcast(types), "entity_type", "left_semi")


def erased(mappings: DataFrame, subjects: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The mappings without those of the subjects, and a certificate for each subject: rows removed and a hash of what was done."""
    gone = subjects.select(key).distinct()
    rest = mappings.join(gone, key, "left_anti")
    removed = mappings.join(gone, key).groupBy(key).agg(F.count("*").alias("removed"))
    text = F.concat_ws("|", F.col(key).cast("string"), F.col("removed").cast("string"))
    return rest, removed.select(key, "removed", F.sha2(text, 256).alias("integrity"))


def unexpired(mappings: DataFrame, now: Column) -> DataFrame:
    """Mappings that have not run out; one without an end never does."""
    return mappings.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def decision(entities: str, mode: str, protected: tuple[str, ...], least: float = 0.5) -> Column:
    """What a guard does with a text: pass, anonymize, block or alert."""
    hit = F.exists(entities, lambda e: (e["score"] >= least) & e["entity_type"].isin(*protected))
    anything = F.size(entities) > 0
    return {"transparent": F.lit("pass"), "anonymize": F.when(anything, "anonymize").otherwise("pass"), "block": F.when(hit, "block").otherwise("pass"), "alert": F.when(hit, "alert").otherwise("pass")}[mode]


GUARD_MODES = ("block", "redact", "roundtrip", "log")


def guarded(found: DataFrame, mode: str, text: str = "text", entities: str = "entities", column: str = "guarded") -> DataFrame:
    """``column`` for retrieved or chained texts: struct (text, blocked, pairs).

    ``block`` gives no text where an entity was found, ``redact`` one with ``[REDACTED]``, ``roundtrip`` one with numbered
    tags and the pairs (replacement, original) that ``anonymize.restore`` turns back, ``log`` the text as it is. Overlapping
    entities must have been resolved.
    """
    if mode not in GUARD_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kind = "array<struct<replacement:string,original:string>>"
    none, any_ = f"cast(array() as {kind})", f"size({entities}) > 0"
    if mode in ("block", "log"):
        new = f"if({any_}, null, {text})" if mode == "block" else text
        return found.withColumn(column, F.expr(f"named_struct('text', {new}, 'blocked', {any_ if mode == 'block' else 'false'}, 'pairs', {none})"))
    operator = anonymize.redact("[REDACTED]") if mode == "redact" else anonymize.replace(numbered=True)
    out = anonymize.anonymize(found, {"*": operator}, text=text, column="__new", entities=entities)
    pairs = "transform(__new.transformations, t -> named_struct('replacement', t.replacement, 'original', t.text))" if mode == "roundtrip" else none
    return out.withColumn(column, F.expr(f"named_struct('text', __new.text, 'blocked', false, 'pairs', {pairs})")).drop("__new")


def impact_report(score: dict, types: list[str]) -> str:
    """An impact assessment of one policy in Markdown, from a row of ``impact_scores`` and the types processed; ``impact_page`` has it in HTML."""
    regulation, _, mapping, audit, unknown, blocks, strips, most, violation = PACKS[score["policy"]]
    measures = [f"mappings are kept for {mapping} days", f"audit rows are kept for {audit} days", f"unknown types: {unknown}", f"on a violation: {violation}"]
    measures += ["risky combinations are blocked"] * blocks + ["control characters are stripped"] * strips + [f"texts end after {most} characters"] * bool(most)
    rows = "\n".join(f"| {t} | {SENSITIVITY.get(t, 10)} |" for t in sorted(set(types)))
    return f"# Impact of {score['policy']} ({regulation})\n\nRisk {score['score']} of 100: {score['band']}\n\n| type | weight |\n|-|-|\n{rows}\n\n" + "\n".join(f"- {m}" for m in measures) + "\n"


def impact_page(score: dict, types: list[str]) -> str:
    """``impact_report`` as HTML, with every value escaped."""
    rows = "".join(f"<tr><td>{html.escape(t)}</td><td>{SENSITIVITY.get(t, 10)}</td></tr>" for t in sorted(set(types)))
    measures = "".join(f"<li>{html.escape(x[2:])}</li>" for x in impact_report(score, types).splitlines() if x.startswith("- "))
    return f"<h1>Impact of {html.escape(str(score['policy']))}</h1><p>Risk {int(score['score'])} of 100: {html.escape(str(score['band']))}</p><table>{rows}</table><ul>{measures}</ul>"
