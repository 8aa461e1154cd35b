"""Default parameters of the analytical models.

Every operator takes its parameters as arguments; the values below are the
defaults. All of them are fixed values: results only match published ones when
labels, thresholds, weights and patterns are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: column lookup -------------------------------------------------

ACTOR_ALIASES = {
    "year": ["year", "anio", "ano", "a_o", "vigencia", "periodo", "period", "fecha_year"],
    "total": ["total", "count", "n", "casos", "eventos", "events", "conteo", "num", "numero", "cantidad"],
    "actor": [
        "gao", "grupo", "actor", "organizacion", "organizacion_criminal", "organization",
        "grupo_armado", "grupo_armado_organizado", "grupo_armado_organizado_gao",
    ],
}

# Names that tell the columns of an actor table apart when none of the aliases is there.
ACTOR_PATTERNS = {
    "actor": ["^gao$", "grupo", "actor", "organizacion", "estructura"],
    "year": ["^year$", "^anio$", "^ano$", "vigencia", "fecha"],
    "total": ["^total$", "integrantes", "miembros", "size", "capacidad", "conteo", "count"],
}

LONG_PATTERNS = {
    "category": ["^categoria$", "categoria_"],
    "indicator": ["^indicador$", "indicador_"],
    "period": ["^anio$", "^year$", "^ano$"],
    "value": ["^valor$", "value"],
    "unit": ["^unidad$", "unit"],
    "reported_pct": ["variacion", "pct", "porcent"],
    "notes": ["nota", "fuente", "documento"],
    "missing_type": ["missing", "imput", "tipo"],
}

# --- fixed values: growth decomposition -------------------------------------------
# The middle bands never occur in published results; their labels are ours.

GROWTH_BANDS = [
    (">", 0.25, "Alto Crecimiento (>25%)"),
    (">", 0.10, "Crecimiento Moderado (10-25%)"),
    (">", 0.0, "Bajo Crecimiento (0-10%)"),
]
GROWTH_REST = "Decrecimiento/NA"

CONTRIBUTION_BANDS = [
    (">", 0.20, "Motor Principal (>20%)"),
    (">", 0.10, "Contribuyente Alto (10-20%)"),
    (">=", 0.05, "Contribuyente Medio (5-10%)"),
    (">", 0.0, "Contribuyente Menor (<5%)"),
]
CONTRIBUTION_REST = "Sin crecimiento"

# --- fixed values: concentration --------------------------------------------------

SHARE_BUCKETS = [("<=", 1, "Leader"), ("<=", 3, "Top 3"), ("<=", 5, "Top 5"), ("<=", 10, "Top 10")]
ACTOR_SHARE_BUCKETS = [("<=", 1, "Market Leader"), ("<=", 3, "Top 3"), ("<=", 5, "Top 5"), ("<=", 10, "Top 10")]
SHARE_REST = "Others"

HHI_CATEGORIES = [
    ("<", 1000, "No concentrado"),
    ("<", 1800, "Moderadamente concentrado"),
    ("<", 2500, "Concentrado"),
]
HHI_CATEGORY_REST = "Altamente concentrado"

HHI_IMPLICATIONS = [
    ("<", 1000, "Alta fragmentación - difícil negociar/contener por un solo vector"),
    ("<", 1800, "Concentración moderada - hay vectores líderes explotables"),
    ("<", 2500, "Oligopolio emergente - riesgo de dominancia de pocos vectores"),
]
HHI_IMPLICATION_REST = "Cuasi-monopolio - un shock domina; respuesta debe ser prioritaria y quirúrgica"

ACTOR_HHI_IMPLICATIONS = [
    ("<", 1000, "Alta fragmentación - dificultad de negociación"),
    ("<", 1800, "Competencia con líderes - oportunidad para 'divide y vencerás'"),
    ("<", 2500, "Oligopolio emergente - riesgo de coordinación criminal"),
]
ACTOR_HHI_IMPLICATION_REST = "Cuasi-monopolio - requiere estrategia de desarticulación prioritaria"

ENTRY_BARRIERS = [(">", 2500, "Very High"), (">", 1800, "High"), (">", 1000, "Moderate")]
ENTRY_BARRIER_REST = "Low"
BARRIER_TEXT = {
    "Very High": "Mercado cerrado a nuevos actores",
    "High": "Alto costo de entrada",
    "Moderate": "Entrada posible con recursos",
    "Low": "Mercado abierto a competencia",
}

MOBILITY_BANDS = [
    (">", 2, "Significant Improvement"),
    (">", 0, "Slight Improvement"),
    ("==", 0, "Stable"),
    (">", -2, "Slight Decline"),
]
MOBILITY_REST = "Significant Decline"

DOMINANCE_THRESHOLD = 0.40

# --- fixed values: scenarios ------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """``rate`` drives every kind; ``ceiling`` (absolute) or ``ceiling_multiple``
    (times the base value) is the level a logistic path approaches."""

    scenario_id: int
    name: str
    rate: float
    kind: str = "exponential"
    ceiling: float | None = None
    ceiling_multiple: float | None = None
    slowdown: float = 0.15
    description: str = ""
    color: str = ""


SCENARIOS = (
    Scenario(1, "Continuidad", 0.235, description="Tendencia actual (+23.5% anual)", color="#D32F2F"),
    Scenario(2, "Contención Parcial", 0.10, description="Estrategia moderadamente exitosa (+10%)", color="#FF9800"),
    Scenario(3, "Estabilización", 0.00, description="Meta de política pública (0%)", color="#4CAF50"),
    Scenario(4, "Reversión", -0.05, description="Escenario optimista (-5%)", color="#2196F3"),
    Scenario(5, "Saturación", 0.35, kind="logistic", ceiling=35000.0,
             description="Límite ecológico del conflicto", color="#9C27B0"),
)
BASELINE_SCENARIO = "Continuidad"
BASE_CAPACITY = 27121.0
BASE_YEAR = 2025
PROJECTION_YEARS = (2026, 2027, 2028, 2029, 2030)
THRESHOLDS = {"crisis": 40000.0, "high_risk": 30000.0, "medium_risk": 25000.0}
RATE_START, RATE_STEP, RATE_COUNT = 0.15, 0.01, 16

# --- fixed values: composite index ------------------------------------------------


@dataclass(frozen=True)
class Dimension:
    """0/1 flag: category in ``categories`` and/or lower-cased indicator matches ``pattern``."""

    name: str
    pattern: str
    categories: tuple[str, ...] = ()
    mode: str = "any"


DIMENSIONS = (
    Dimension("control", "extors|amenaz|secuest|homicid|confin|desplaz|misiones|lideres",
              ("Seguridad_Ciudadana", "Impacto_Humanitario")),
    Dimension("innov", "dron|drones"),
    Dimension("dispute", "enfrent|disputa|zonas", ("Conflicto",), mode="all"),
)
WEIGHTS = {"control": 0.40, "innov": 0.25, "dispute": 0.20, "shock": 0.15}
STOCK_WEIGHT, STOCK_CAP = 0.05, 0.08

TYPOLOGY = [
    ((("control", 0.60), ("shock", 0.30)), "Control social + shock"),
    ((("innov", 0.50),), "Innovación táctica"),
    ((("dispute", 0.50),), "Competencia/Disputa"),
    ((("stock", 0.50),), "Dominante por nivel (stock)"),
]
TYPOLOGY_REST = "Mixto"

PRIORITY_BANDS = [(">=", 0.70, "Alta Prioridad"), (">=", 0.40, "Media Prioridad")]
PRIORITY_REST = "Baja Prioridad"

LEGACY_WEIGHTS = {"social": 0.35, "tech": 0.20, "dispute": 0.20, "shock": 0.15, "growth_share": 0.05,
                  "stock_share": 0.05}

# --- fixed values: risk score -----------------------------------------------------


@dataclass(frozen=True)
class RiskIndicator:
    code: str
    name: str
    weight: float
    direction: str
    patterns: tuple[str, ...]


# Listed in output order; a code applies when all its patterns match, first match wins.
RISK_INDICATORS = (
    RiskIndicator("ENF", "Enfrentamientos entre grupos", 1.0, "+", ("enfrent",)),
    RiskIndicator("DRN", "Ataques con drones", 1.5, "+", ("dron",)),
    RiskIndicator("SEQ", "Secuestros", 1.2, "+", ("secuest",)),
    RiskIndicator("DES", "Desplazamiento forzado", 1.0, "+", ("desplaz",)),
    RiskIndicator("HLS", "Homicidios líderes sociales", 0.8, "-", ("homicid", "lider")),
    RiskIndicator("ATC", "Ataques a misiones médicas", 0.9, "+", ("mision", "medic")),
)
SCORE_BANDS = [(">=", 100, 3), (">=", 50, 2), (">=", 20, 1)]
MAX_POINTS = 3
RED_THRESHOLD, AMBER_THRESHOLD = 7.0, 4.0
RISK_CLASSES = ("ALTO (ROJO)", "MEDIO (ÁMBAR)", "BAJO (VERDE)")
SHORT_CLASSES = ("ROJO", "ÁMBAR", "VERDE")

# code -> (start, step, count) of the weights tried
WEIGHT_GRID = {"ENF": (0.8, 0.1, 5), "DRN": (1.3, 0.1, 5), "SEQ": (1.0, 0.1, 5)}

IMPLICATIONS = {
    "ALTO (ROJO)": (
        ["Activar protocolo de crisis estratégica", "Revisión urgente de doctrina operativa",
         "Aumento de inteligencia y vigilancia", "Coordinación interagencial prioritaria"],
        ["Reasignación de recursos a zonas críticas", "Refuerzo de capacidades de respuesta rápida",
         "Diplomacia de crisis con actores regionales"],
    ),
    "MEDIO (ÁMBAR)": (
        ["Reforzar monitoreo de indicadores", "Ajustes operativos preventivos",
         "Coordinación interinstitucional"],
        ["Mejora de capacidades de inteligencia", "Fortalecimiento de respuesta temprana",
         "Diálogo preventivo con comunidades"],
    ),
    "BAJO (VERDE)": (
        ["Mantener monitoreo rutinario", "Continuar estrategias actuales",
         "Fortalecer capacidades preventivas"],
        ["Inversión en capacidades a largo plazo", "Mejora de sistemas de alerta temprana",
         "Diplomacia preventiva"],
    ),
}
CRITICAL_SCORE = 2.0
