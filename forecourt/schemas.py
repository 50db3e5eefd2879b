"""Tables and fields of the engine."""

from __future__ import annotations

SOURCE_A, SOURCE_B = "dealer-feed-a", "marketplace-b"
SOURCES = [SOURCE_A, SOURCE_B]

#: Canonical fields of a raw record, and their names in source B's header (fixed values).
FRENCH = {
    "vin": "vin",
    "vendeur_id": "sellerId",
    "numero_stock": "stockNumber",
    "prix": "price",
    "devise": "currency",
    "kilometrage": "odometer",
    "marque": "make",
    "modele": "model",
    "annee": "year",
    "version": "trim",
    "carrosserie": "bodyStyle",
    "carburant": "fuelType",
    "couleur_ext": "exteriorColor",
    "couleur_int": "interiorColor",
    "etat": "condition",
    "province": "province",
    "ville": "city",
    "latitude": "latitude",
    "longitude": "longitude",
    "date_annonce": "listedAt",
    "statut": "status",
}
FIELDS = list(FRENCH.values())

#: Silver tables: columns with types, and the natural key.
SILVER = {
    "vehicles": (
        "vin string, wmi string, make string, model string, model_year int, trim string, body_style string, fuel_type string, drive_train string, "
        "transmission string, decode_source string, first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp",
        ["vin"],
    ),
    "listings": (
        "id string, vin string, source string, source_listing_id string, batch_id string, price_cents long, currency string, odometer_km int, trim_raw string, "
        "province string, city string, latitude decimal(9,6), longitude decimal(9,6), status string, year_conflict boolean, listed_at timestamp, delisted_at timestamp, "
        "make string, model string, model_year int, created_at timestamp, updated_at timestamp",
        ["source", "source_listing_id"],
    ),
    "price_history": ("vin string, listing_id string, price_cents long, observed_at timestamp", []),
    "quarantine": (
        "source string, batch_id string, raw_record string, reason_codes array<string>, content_hash string, quarantined_at timestamp, resolved_at timestamp",
        ["source", "batch_id", "content_hash"],
    ),
    "pipeline_runs": (
        "id string, run_id string, stage string, source string, batch_id string, rows_in long, rows_out long, rejects long, started_at timestamp, finished_at timestamp, "
        "duration_ms long, status string",
        [],
    ),
    "quality_metrics": ("run_id string, source string, metric_name string, metric_value double, computed_at timestamp", []),
    "decode_cache": (
        "wmi_vds_prefix string, valid boolean, make string, model string, year int, trim string, series string, body_style string, fuel_type string, drive_type string, "
        "transmission string, decoded_at timestamp",
        ["wmi_vds_prefix"],
    ),
}
DECODED = "decoded"
UNDECODED = "undecoded"
