"""The gold levels, texts and what they state.

A level is (level, text, lists of records); a record is (record type, fields).
The values must be these for results to be comparable.
"""

from __future__ import annotations

TEXT_1 = """
Für diese Schweißaufgabe verwenden wir das MIG-Schweißgerät Fronius TPS 400i.
Als Zusatzwerkstoff kommt der Schweißdraht ER70S-6 mit 1,0mm Durchmesser zum Einsatz.
Das Schutzgas ist eine Mischung aus 82% Argon und 18% CO2.
"""  # noqa: W291
TEXT_2 = """
Die Schweißprozedur WPS-2024-042 für die MIG-Schweißung von S235 T-Stößen
besteht aus vier Schritten: Zuerst wird das Werkstück vorbereitet, dann erfolgt
das Heften, anschließend die Wurzellage, und zum Schluss die Decklage.
"""  # noqa: W291
TEXT_3 = """
Für die Wurzellage wird das MIG-Schweißgerät Fronius TPS 400i benötigt.
Der Schweißstrom soll auf 180 Ampere eingestellt werden, die Spannung auf
24 Volt, und die Drahtvorschubgeschwindigkeit auf 8 m/min.
Wichtig: Die Kontaktspitze muss auf 1,0mm Drahtdurchmesser eingestellt sein.
"""  # noqa: W291
TEXT_4 = """
Am 11.10.2024 um 14:30 hat der Schweißer Hans Müller die Wurzellage
durchgeführt. Er hat das Fronius TPS 400i verwendet, allerdings den
Schweißstrom auf 185A eingestellt statt der vorgeschriebenen 180A.
Die Spannung lag bei 24V. Der Schritt hat 12 Minuten gedauert und
wurde erfolgreich abgeschlossen, trotz der Abweichung beim Strom.
"""  # noqa: W291
TEXT_5 = """
Am 11.10.2024 wurde die Schweißprozedur WPS-2024-042 (MIG-Schweißung S235 T-Stoß)
durchgeführt. Das Team bestand aus Schweißer Hans Müller und Qualitätsprüferin
Maria Schmidt. Schweißfachingenieur Dr. Weber hatte die Aufsicht.

Hans hat zuerst das Werkstück vorbereitet (10 Minuten), dann geheftet (5 Minuten).
Bei der Wurzellage (12 Minuten) hat er den Strom auf 185A gesetzt statt der
vorgeschriebenen 180A. Er hat nachgefragt, ob das in Ordnung sei. Dr. Weber hat
bestätigt, dass 185A noch im Toleranzbereich liegt.

Die Decklage lief ohne Probleme (15 Minuten).

Maria hat anschließend die Schweißnaht nach EN ISO 5817 Bewertungsgruppe B
geprüft. Ergebnis: akzeptiert, geringfügige Porosität festgestellt, keine
Nacharbeit erforderlich.

Gesamtergebnis: abgenommen mit Anmerkungen.
"""  # noqa: W291

PREPARE = {"name": "Werkstück vorbereiten", "step_number": 1, "step_type": "preparation"}
TACK = {"name": "Heften", "step_number": 2, "step_type": "execution"}
ROOT = {"name": "Wurzellage", "step_number": 3, "step_type": "execution", "is_critical": True}
COVER = {"name": "Decklage", "step_number": 4, "step_type": "execution"}
TORCH = {"name": "Fronius TPS 400i", "tool_type": "welding", "manufacturer": "Fronius"}
HANS = {"name": "Hans Müller", "role": "operator"}
SKILLED_HANS = {"name": "Hans Müller", "role": "operator", "expertise_level": "skilled"}
MARIA = {"name": "Maria Schmidt", "role": "quality_inspector"}
WEBER = {"name": "Dr. Weber", "role": "welding_engineer"}
CURRENT_185 = {"name": "Schweißstrom", "parameter_type": "current", "unit": "A", "nominal_value": 185.0}
VOLTAGE_24 = {"name": "Spannung", "parameter_type": "voltage", "unit": "V", "nominal_value": 24.0}
ROOT_DONE = {"step": {"name": "Wurzellage", "step_number": 3}, "executed_by": HANS, "status": "completed"}

LEVEL_1 = [
    ("Tool", {"name": "Fronius TPS 400i", "tool_type": "welding", "manufacturer": "Fronius", "model": "TPS 400i", "source_text": "MIG-Schweißgerät Fronius TPS 400i"}),
    ("Material", {"name": "ER70S-6 Schweißdraht", "material_type": "filler", "specification": "ER70S-6", "dimensions": "1,0mm Durchmesser", "source_text": "Schweißdraht ER70S-6 mit 1,0mm Durchmesser"}),
    ("Material", {"name": "Schutzgas Argon/CO2 82/18", "material_type": "shielding gas", "specification": "82% Argon, 18% CO2", "source_text": "Schutzgas ist eine Mischung aus 82% Argon und 18% CO2"}),
]
PROCEDURE_2 = {"name": "MIG-Schweißung S235 T-Stoß", "procedure_id": "WPS-2024-042", "domain": "welding", "status": "active", "source_text": "Schweißprozedur WPS-2024-042 für die MIG-Schweißung von S235 T-Stößen"}
ORDERS_2 = [
    ("StepOrder", {"before": PREPARE, "after": TACK, "source_text": "Zuerst wird das Werkstück vorbereitet, dann erfolgt das Heften"}),
    ("StepOrder", {"before": TACK, "after": ROOT, "source_text": "dann erfolgt das Heften, anschließend die Wurzellage"}),
    ("StepOrder", {"before": ROOT, "after": COVER, "source_text": "anschließend die Wurzellage, und zum Schluss die Decklage"}),
]
LEVEL_3 = {
    "step": ROOT, "tool": TORCH, "is_mandatory": True, "configuration_notes": "Kontaktspitze auf 1,0mm Drahtdurchmesser einstellen",
    "parameters": [
        {"name": "Schweißstrom", "parameter_type": "current", "unit": "A", "nominal_value": 180.0}, VOLTAGE_24,
        {"name": "Drahtvorschubgeschwindigkeit", "parameter_type": "speed", "unit": "m/min", "nominal_value": 8.0},
    ],
    "source_text": "Für die Wurzellage wird das MIG-Schweißgerät Fronius TPS 400i benötigt",
}
LEVEL_4 = {
    "step": ROOT, "executed_by": SKILLED_HANS, "tools_used": [TORCH], "started_at": "2024-10-11T14:30:00", "actual_duration_seconds": 720, "status": "completed", "observed_parameters": [CURRENT_185, VOLTAGE_24],
    "deviation_from_spec": "Schweißstrom auf 185A statt vorgeschriebener 180A eingestellt", "source_text": "Am 11.10.2024 um 14:30 hat der Schweißer Hans Müller die Wurzellage durchgeführt",
}
LEVEL_5 = {
    "procedure": {"name": "MIG-Schweißung S235 T-Stoß", "procedure_id": "WPS-2024-042", "domain": "welding", "status": "active"},
    "executed_by": [SKILLED_HANS, MARIA], "supervised_by": WEBER, "started_at": "2024-10-11T00:00:00", "overall_status": "completed_with_deviations", "overall_result": "accepted_with_conditions", "procedure_version": None,
    "step_executions": [
        {"step": PREPARE, "executed_by": HANS, "actual_duration_seconds": 600, "status": "completed"},
        {"step": TACK, "executed_by": HANS, "actual_duration_seconds": 300, "status": "completed"},
        {"step": ROOT, "executed_by": HANS, "actual_duration_seconds": 720, "status": "completed", "observed_parameters": [CURRENT_185], "deviation_from_spec": "Strom auf 185A statt 180A"},
        {"step": COVER, "executed_by": HANS, "actual_duration_seconds": 900, "status": "completed"},
    ],
    "quality_checks": [{
        "inspector": MARIA, "step_execution": ROOT_DONE, "result": "pass", "findings": "Geringfügige Porosität festgestellt, keine Nacharbeit erforderlich", "corrective_action_required": False,
        "requirement": {"name": "Sichtprüfung Schweißnaht", "requirement_type": "visual", "acceptance_criteria": "EN ISO 5817 Bewertungsgruppe B", "applicable_norm": "EN ISO 5817"},
    }],
    "feedback": [{
        "step_execution": ROOT_DONE, "reported_by": HANS, "feedback_type": "question", "content": "Ist 185A statt 180A in Ordnung?", "severity": "info", "resolved": True,
        "resolution": "Dr. Weber bestätigt: 185A liegt noch im Toleranzbereich", "resolved_by": WEBER,
    }],
    "source_text": "Am 11.10.2024 wurde die Schweißprozedur WPS-2024-042 durchgeführt",
}

LEVELS = [
    (1, TEXT_1, [LEVEL_1]),
    (2, TEXT_2, [[("Procedure", PROCEDURE_2)], [("Step", PREPARE), ("Step", TACK), ("Step", ROOT), ("Step", COVER)], ORDERS_2]),
    (3, TEXT_3, [[("ToolRequirement", LEVEL_3)]]),
    (4, TEXT_4, [[("StepExecution", LEVEL_4)]]),
    (5, TEXT_5, [[("ProcedureExecution", LEVEL_5)]]),
]
