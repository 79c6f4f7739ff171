"""What personal data looks like: column names, value shapes, labels."""

from __future__ import annotations

from dataclasses import dataclass

# Names and categories that must be recognised as they stand, in matching order.
NAMES: tuple[tuple[str, str], ...] = (
    ("name", "name"),
    ("full_name", "name"),
    ("first_name", "name"),
    ("last_name", "name"),
    ("patient_name", "name"),
    ("member_name", "name"),
    ("nama", "name"),
    ("nama_lengkap", "name"),
    ("patientcardnumber", "identifier"),
    ("card_number", "identifier"),
    ("card_no", "identifier"),
    ("member_code", "identifier"),
    ("additional_member_code", "identifier"),
    ("nik", "identifier"),
    ("no_ktp", "identifier"),
    ("npwp", "identifier"),
    ("no_bpjs", "identifier"),
    ("bpjs", "identifier"),
    ("phone", "contact"),
    ("phone_number", "contact"),
    ("mobile", "contact"),
    ("no_hp", "contact"),
    ("no_telepon", "contact"),
    ("store_phone", "contact"),
    ("email", "contact"),
    ("address", "address"),
    ("alamat", "address"),
    ("date_of_birth", "date"),
    ("birth_date", "date"),
    ("dob", "date"),
    ("tanggal_lahir", "date"),
)
#: Words of a column name that speak of organisations, not persons (fuzzy matching only).
ORGANISATION = ("company", "companies", "corporate", "business", "employer", "organisation", "organization", "firm")
FUZZY_LEAST = 0.8
#: Least share of values with a shape.
SHAPE_LEAST = 0.3


@dataclass(frozen=True)
class Shape:
    """A value detector. Patterns use ASCII classes in every engine."""

    name: str
    pattern: str
    category: str
    label: str
    description: str


SHAPES = (
    Shape("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "contact", "EMAIL", "email address"),
    Shape("phone", r"(\+?\d[\d\s\-().]{6,}\d)", "contact", "PHONE", "phone number"),
    Shape("credit_card", r"\b(?:\d[ \-]?){13,19}\b", "identifier", "CARD", "payment card number"),
    Shape("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "identifier", "IBAN", "bank account number"),
    Shape("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "contact", "IP", "IPv4 address"),
    Shape("url_credentials", r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:]+:[^/\s@]+@", "identifier", "URL", "URL with credentials"),
    Shape("nik", r"\b\d{16}\b", "identifier", "NIK", "Indonesian identity number"),
    Shape("npwp", r"\b\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}\b", "identifier", "NPWP", "Indonesian tax number"),
    Shape("bpjs", r"\b\d{13}\b", "identifier", "BPJS", "Indonesian insurance number"),
)
BY_NAME = {s.name: s for s in SHAPES}
#: A run of digits that may be a card.
CARD_RUN = r"\d(?:[ \-]?\d){12,18}"
INDONESIAN_SHAPES = ("nik", "npwp", "bpjs")
INDONESIAN_NAMES = ("nama", "nama_lengkap", "nik", "no_ktp", "npwp", "no_bpjs", "bpjs", "no_hp", "no_telepon", "alamat", "tanggal_lahir")

#: Labels of typed tokens: the first part of a field's name that occurs decides.
LABELS = (("email", "EMAIL"), ("phone", "PHONE"), ("contact", "CONTACT"), ("name", "PERSON"), ("address", "ADDRESS"), ("identifier", "ID"), ("date", "DATE"))
TOKEN = r"<[A-Z_]+_\d+>"
TOKEN_ONLY = r"^(REDACTED_\d{4,}|<[A-Z_]+_\d+>)$"

#: Presets: name, locale, extra (pattern, category) pairs.
PRESETS = {
    "id": ("id_ID", tuple((p, c) for p, c in NAMES if p in INDONESIAN_NAMES) + (("nomor_ktp", "identifier"), ("no_kk", "identifier"), ("no_rekening", "identifier"), ("nama_ibu", "name"), ("no_handphone", "contact"))),
}
