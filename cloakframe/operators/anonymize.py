"""Anonymization: operators over entities, text rebuilt from gaps and replacements, and the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import begins, let, lit

Operator = Callable[[str, str, str], str]


def redact(placeholder: str = "") -> Operator:
    return lambda kind, text, n: lit(placeholder)


def replace(tag: str | None = None, numbered: bool = False) -> Operator:
    """``<TAG>`` or ``<TAG_n>``; numbers run by type from the end of the text backwards."""
    name = lambda kind: kind if tag is None else lit(tag)
    return lambda kind, text, n: f"concat('<', {name(kind)}, '_', {n}, '>')" if numbered else f"concat('<', {name(kind)}, '>')"


def mask(prefix: int = 1, suffix: int = 0, char: str = "*", per_word: bool = False) -> Operator:
    """All but the first and last characters; what is not longer than those is masked whole."""
    def one(s: str) -> str:
        tail = f"right({s}, {suffix})" if suffix else "''"
        return f"if(length({s}) <= {prefix + suffix}, repeat({lit(char)}, length({s})), concat(left({s}, {prefix}), repeat({lit(char)}, length({s}) - {prefix + suffix}), {tail}))"

    if per_word:
        return lambda kind, text, n: f"array_join(transform(filter(split({text}, '\\\\s+'), x -> x <> ''), x -> {one('x')}), ' ')"
    return lambda kind, text, n: one(text)


def hashed(algorithm: str = "sha256", salt: str = "", scoped: bool = False) -> Operator:
    """``alg:`` and the first 16 hex digits of SHA-256 or SHA-512. BLAKE3 has no native form: see ``functions.crypto.blake3_hex``."""
    if algorithm not in ("sha256", "sha512"):
        raise ValueError(f"no native hash {algorithm!r}")
    return lambda kind, text, n: f"concat({lit(algorithm + ':')}, left(sha2(concat({lit(salt)}, {f'{kind}, {lit(chr(58))},' if scoped else ''} {text}), {algorithm[3:]}), 16))"


def pseudonym(salt: str = "", by_place: bool = False) -> Operator:
    """A label with ten hex digits of a salted SHA-256; equal texts get equal labels unless places are mixed in."""
    return lambda kind, text, n: f"concat('⟨', {kind}, ':', left(sha2(concat_ws('|', {lit(salt)}, {kind}, {text}{', ' + n if by_place else ''}), 256), 10), '⟩')"


def encrypted(key: str, aad: str = "", nonce: str | None = None) -> Operator:
    """AES-256-GCM, nonce, text and tag in hex. ``key`` and ``nonce`` are SQL expressions of binaries, so that keys come from columns; a fixed nonce is for tests only."""
    iv = f", {nonce}, {lit(aad)}" if nonce else f", unhex(''), {lit(aad)}"
    return lambda kind, text, n: f"concat('enc:v1:', lower(hex(aes_encrypt({text}, {key}, 'GCM', 'DEFAULT'{iv}))))"


def decrypted(value: str, key: str, aad: str = "") -> str:
    return f"cast(aes_decrypt(unhex(substring({value}, 8)), {key}, 'GCM', 'DEFAULT', {lit(aad)}) as string)"


def format_preserving(key: str, nonce: str, back: bool = False) -> Operator:
    """Each digit moved by a keystream byte modulo 10: the first byte of AES-256 over a nonce of 12 bytes and the place."""
    sign = "-" if back else "+"

    def op(kind: str, text: str, n: str) -> str:
        block = f"aes_encrypt(concat({nonce}, unhex(lpad(hex(i - 1), 8, '0'))), {key}, 'ECB', 'PKCS')"
        moved = f"pmod(cast(substring({text}, i, 1) as int) {sign} conv(left(hex({block}), 2), 16, 10), 10)"
        return f"if(length({text}) = 0, '', array_join(transform(sequence(1, length({text})), i -> if(substring({text}, i, 1) between '0' and '9', cast(cast({moved} as int) as string), substring({text}, i, 1))), ''))"

    return op


SEALED = "enc:v1:"


def sealed_under(key_id: str, key: str, aad: str = "", nonce: str | None = None) -> Operator:
    """``encrypted`` with the key's name in front, so that keys may be rotated."""
    iv = f", {nonce}, {lit(aad)}" if nonce else f", unhex(''), {lit(aad)}"
    return lambda kind, text, n: f"concat({lit(f'{SEALED}{key_id}:')}, lower(hex(aes_encrypt({text}, {key}, 'GCM', 'DEFAULT'{iv}))))"


def opened(value: str, keys: dict[str, str], aad: str = "") -> str:
    """SQL text: what a value of ``sealed_under`` holds; an unknown key's name or a wrong key is an error."""
    name = f"substring_index(substring({value}, {len(SEALED) + 1}), ':', 1)"
    cases = " ".join(f"when {lit(k)} then cast(aes_decrypt(unhex(substring_index({value}, ':', -1)), {key}, 'GCM', 'DEFAULT', {lit(aad)}) as string)" for k, key in keys.items())
    return f"case {name} {cases} else raise_error(concat('no key ', {name})) end"


def rotated(value: str, keys: dict[str, str], key_id: str, aad: str = "", nonce: str | None = None) -> str:
    """SQL text: a sealed value under another of the keys."""
    return sealed_under(key_id, keys[key_id], aad, nonce)("''", opened(value, keys, aad), "''")


def anonymize(found: DataFrame, operators: dict[str, Operator], default: Operator | None = None, text: str = "text", column: str = "anonymized", entities: str = "entities") -> DataFrame:
    """``column``, a struct of the new text and its transformations.

    An entity's operator is that of its type, of ``*``, the default, or ``<PII>``. Overlapping entities must have been resolved
    (``fusion.longest_only``); of those that still overlap the first stays.
    """
    default = operators.get("*") or default or replace("PII")
    src = f"coalesce({text}, '')"
    serial = f"cast(size(filter({entities}, o -> o.entity_type = e.entity_type and o.start >= e.start)) as string)"
    cases = " ".join(f"when e.entity_type = {lit(k)} then {op('e.entity_type', 'e.text', serial)}" for k, op in operators.items() if k != "*")
    new = f"case {cases} else {default('e.entity_type', 'e.text', serial)} end" if cases else default("e.entity_type", "e.text", serial)
    step = "struct<start:int,end:int,entity_type:string,text:string,replacement:string>"
    steps = f"transform(array_sort({entities}), e -> named_struct('start', e.start, 'end', e.end, 'entity_type', e.entity_type, 'text', e.text, 'replacement', {new}))"
    kept = f"aggregate({steps}, named_struct('at', 0, 'out', cast(array() as array<{step}>)), (a, s) -> if(s.start < a.at, a, named_struct('at', s.end, 'out', concat(a.out, array(s)))), a -> a.out)"

    def whole(ks: str) -> str:
        # The text once, from pieces between entities; places by running sums of how much longer each replacement is.
        gap = lambda i: f"substring({src}, if({i} = 0, 0, {ks}[{i} - 1].end) + 1, {ks}[{i}].start - if({i} = 0, 0, {ks}[{i} - 1].end))"
        body = f"concat(array_join(transform({ks}, (k, i) -> concat({gap('i')}, k.replacement)), ''), substring({src}, {ks}[size({ks}) - 1].end + 1))"
        moved = f"transform({ks}, k -> length(k.replacement) - (k.end - k.start))"
        done = lambda at: f"transform({ks}, (k, i) -> named_struct('start', k.start, 'end', k.end, 'entity_type', k.entity_type, 'text', k.text, 'replacement', k.replacement, 'final_start', k.start + {at}[i], 'final_end', k.start + {at}[i] + length(k.replacement)))"
        full = "array<struct<start:int,end:int,entity_type:string,text:string,replacement:string,final_start:int,final_end:int>>"
        return f"if(size({ks}) = 0, named_struct('text', {src}, 'transformations', cast(array() as {full})), named_struct('text', {body}, 'transformations', {let(moved, lambda m: let(begins(m), done))}))"

    return found.withColumn(column, F.expr(let(kept, whole)))


def deanonymize(value: str, transformations: str, original: str = "t.text") -> Column:
    """The text back: every replacement is checked to stand where it was put; if one does not, the result is null.

    ``original`` is SQL of a transformation ``t``: its stored text, or what its replacement gives under a key (``opened``).
    """
    same = f"forall({transformations}, t -> substring({value}, t.final_start + 1, t.final_end - t.final_start) = t.replacement)"
    ts = transformations
    gap = f"substring({value}, if(i = 0, 0, {ts}[i - 1].final_end) + 1, t.final_start - if(i = 0, 0, {ts}[i - 1].final_end))"
    back = f"concat(array_join(transform({ts}, (t, i) -> concat({gap}, {original})), ''), substring({value}, coalesce(try_element_at({ts}, -1).final_end, 0) + 1))"
    return F.expr(f"if({same}, {back}, null)")


def merged_payloads(parts: DataFrame, key: str, order: str, transformations: str = "transformations", hints: str = "hints") -> DataFrame:
    """(key, transformations, hints): the transformations of several texts in order, and their hints, a later one over an earlier."""
    own = F.collect_list(F.struct(F.col(order).alias("o"), F.col(transformations).alias("t"), F.col(hints).alias("h")))
    rows = parts.groupBy(key).agg(own.alias("own")).withColumn("own", F.expr("array_sort(own, (x, y) -> case when x.o < y.o then -1 when x.o > y.o then 1 else 0 end)"))
    pairs = "filter(flatten(transform(own, x -> map_entries(x.h))), e -> e.key <> '' and e.value <> '')"
    last = f"transform(array_distinct(transform({pairs}, e -> e.key)), k -> named_struct('key', k, 'value', element_at(filter({pairs}, e -> e.key = k), -1).value))"
    return rows.select(key, F.expr("flatten(transform(own, x -> x.t))").alias("transformations"), F.expr(f"map_from_entries({last})").alias("hints"))


def restore(answer: str, pairs: str) -> Column:
    """An answer with replacements turned back, longest first; ``pairs`` is an array of (replacement, original)."""
    return F.expr(f"aggregate(array_sort(array_distinct({pairs}), (x, y) -> case when length(x.replacement) <> length(y.replacement) then length(y.replacement) - length(x.replacement) when x.replacement < y.replacement then -1 else 1 end), {answer}, (a, p) -> replace(a, p.replacement, p.original))")


def operators_by_policy(policy: dict[str, str], key: str | None = None, nonce: str | None = None) -> dict[str, Operator]:
    """Operators by type from their names; names without a counterpart redact. ``fpe`` and ``encrypt`` need a key, so that nothing is lost unasked."""
    known = {"mask": mask(2), "hash": hashed(), "replace": replace(), "redact": redact("[REDACTED]"), "pseudonymize": pseudonym(), "tokenize": pseudonym("token")}
    if key is not None:
        known |= {"encrypt": encrypted(key), "fpe": format_preserving(key, nonce or "unhex(repeat('00', 12))")}
    elif lost := {"encrypt", "fpe"} & set(policy.values()):
        raise ValueError(f"a key is needed for {sorted(lost)}")
    return {k: known.get(name, redact("[REDACTED]")) for k, name in policy.items()}
