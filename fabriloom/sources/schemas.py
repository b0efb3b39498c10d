"""Tables of the process-control model: columns, keys, references and text widths."""

from __future__ import annotations

DDL = {
    "lots": "lot_id BIGINT, product STRING, technology_node STRING, start_date DATE, status STRING",
    "wafers": "wafer_id BIGINT, lot_id BIGINT, wafer_number INT, status STRING",
    "process_steps": "step_id INT, step_name STRING, tool_id STRING, layer STRING, sequence_order INT",
    "measurements": "measurement_id BIGINT, wafer_id BIGINT, step_id INT, parameter STRING, value DOUBLE, unit STRING, timestamp TIMESTAMP_NTZ",
    "yield_records": "record_id BIGINT, wafer_id BIGINT, die_count INT, pass_count INT, yield_pct DOUBLE, defect_density DOUBLE",
}
FLAGS_DDL = "flag_id BIGINT, measurement_id BIGINT, step_id INT, parameter STRING, rule_violated STRING, flagged_at TIMESTAMP_NTZ"
COLUMNS = {table: [c.split()[0] for c in ddl.split(", ")] for table, ddl in {**DDL, "spc_flags": FLAGS_DDL}.items()}
PRIMARY_KEYS = {"lots": "lot_id", "wafers": "wafer_id", "process_steps": "step_id", "measurements": "measurement_id", "yield_records": "record_id", "spc_flags": "flag_id"}
#: (child, column, parent, key)
REFERENCES = [("wafers", "lot_id", "lots", "lot_id"), ("measurements", "wafer_id", "wafers", "wafer_id"), ("measurements", "step_id", "process_steps", "step_id"), ("yield_records", "wafer_id", "wafers", "wafer_id"), ("spc_flags", "measurement_id", "measurements", "measurement_id")]
WIDTHS = {
    "lots": {"product": 64, "technology_node": 16, "status": 16},
    "wafers": {"status": 16},
    "process_steps": {"step_name": 64, "tool_id": 32, "layer": 32},
    "measurements": {"parameter": 32, "unit": 16},
    "spc_flags": {"rule_violated": 32},
}
#: table -> rule -> what breaks it, in SQL that reads alike in other engines
RANGES = {
    "yield_records": {
        "yield_in_70_98": "pass_count > 0 AND NOT (yield_pct BETWEEN 70 AND 98)",
        "pass_count_le_die_count": "pass_count > die_count",
        "defect_density_positive": "defect_density <= 0",
        "die_count_positive": "die_count <= 0",
    },
    "wafers": {"wafer_number_1_25": "NOT (wafer_number BETWEEN 1 AND 25)"},
    "lots": {"known_technology_node": "technology_node NOT IN ('28nm', '65nm', '130nm', '180nm')"},
    "measurements": {"value_is_a_number": "isnan(value)"},
}
