"""Fixed schemas and entity types."""

from __future__ import annotations

ENTITY_TYPES = (
    "PERSON EMAIL PHONE CREDIT_CARD IBAN SSN PASSPORT DRIVER_LICENSE IP_ADDRESS URL DATE ADDRESS ORGANIZATION LOCATION "
    "MEDICAL_RECORD NATIONAL_ID TAX_ID BANK_ACCOUNT CRYPTO_WALLET VEHICLE_PLATE"
).split()
CUSTOM = "CUSTOM:"

ENTITY = "struct<start:int,end:int,entity_type:string,text:string,score:double,recognizer:string>"
ENTITIES = f"array<{ENTITY}>"


def parse_entity_type(name: str) -> str:
    """A type's key, trimmed and in upper case; unknown types and empty custom ids are errors."""
    key = name.strip()
    upper = key.upper()
    if upper in ENTITY_TYPES:
        return upper
    if upper.startswith(CUSTOM) and len(upper) > len(CUSTOM):
        return CUSTOM + key[len(CUSTOM) :].strip().upper()
    raise ValueError(f"unknown entity type {name!r}")
