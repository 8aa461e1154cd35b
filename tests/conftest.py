import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Published observations: category, indicator, period, value, unit, reported percentage.
OBSERVATIONS = [
    ("Grupos_Armados", "Total_Integrantes", 2025, 27121.0, "personas", 23.5),
    ("Grupos_Armados", "Hombres_en_Armas", 2025, 13794.0, "personas", 20.0),
    ("Grupos_Armados", "Redes_de_Apoyo", 2025, 13327.0, "personas", 27.0),
    ("Grupos_Armados", "Nuevos_Integrantes_Año", 2025, 5000.0, "personas", None),
    ("Grupos_Armados", "Variacion_Jul_Dic_2025", 2025, 7.0, "porcentaje", None),
    ("Grupos_Armados", "Clan_del_Golfo_Crecimiento", 2025, 30.0, "porcentaje", None),
    ("Grupos_Armados", "Clan_del_Golfo_Nuevos", 2025, 2300.0, "personas", None),
    ("Conflicto", "Enfrentamientos_entre_Grupos", 2025, 115.0, "eventos", 34.0),
    ("Conflicto", "Enfrentamientos_entre_Grupos", 2024, 86.0, "eventos", None),
    ("Conflicto", "Zonas_en_Disputa", 2025, 13.0, "zonas", None),
    ("Conflicto", "Ataques_Infraestructura_Civil_Variacion", 2025, None, "porcentaje", 58.0),
    ("Conflicto", "Ataques_Fuerza_Publica_Variacion", 2025, None, "porcentaje", 62.0),
    ("Conflicto", "Ataques_con_Drones", 2025, 277.0, "eventos", 133.0),
    ("Conflicto", "Ataques_con_Drones", 2024, 119.0, "eventos", None),
    ("Conflicto", "Ataques_Drones_EMC", 2025, 237.0, "eventos", None),
    ("Impacto_Humanitario", "Desplazamiento_Forzado_Variacion", 2025, None, "porcentaje", 85.0),
    ("Impacto_Humanitario", "Desplazados_Catatumbo", 2025, 92000.0, "personas", None),
    ("Impacto_Humanitario", "Afectados_Confinamiento", 2025, 1000000.0, "personas", None),
    ("Impacto_Humanitario", "Afectados_Confinamiento_Multiplicador", 2025, 3.0, "veces", None),
    ("Impacto_Humanitario", "Ataques_Misiones_Medicas_Variacion", 2025, None, "porcentaje", 39.0),
    ("Impacto_Humanitario", "Homicidios_Lideres_Sociales", 2025, 142.0, "personas", -15.5),
    ("Impacto_Humanitario", "Homicidios_Lideres_Sociales", 2024, 168.0, "personas", None),
    ("Seguridad_Ciudadana", "Homicidios_Totales", 2025, 13722.0, "casos", 3.0),
    ("Seguridad_Ciudadana", "Hurto_Comercios_Variacion", 2025, None, "porcentaje", -30.0),
    ("Seguridad_Ciudadana", "Hurto_Automotores_Variacion", 2025, None, "porcentaje", -17.0),
    ("Seguridad_Ciudadana", "Hurto_Residencias_Variacion", 2025, None, "porcentaje", -11.3),
    ("Seguridad_Ciudadana", "Amenazas_Variacion", 2025, None, "porcentaje", -18.0),
    ("Seguridad_Ciudadana", "Extorsion_Variacion", 2025, None, "porcentaje", -1.0),
    ("Seguridad_Ciudadana", "Secuestro", 2025, 651.0, "casos", 133.0),
    ("Seguridad_Ciudadana", "Secuestro", 2024, 279.0, "casos", None),
    ("Estado", "Acciones_Fuerza_Publica_Variacion", 2025, None, "porcentaje", 34.0),
    ("Estado", "Incautaciones_Droga", 2025, 861166.0, "kilogramos", None),
]
SCHEMA = "category string, indicator string, period int, value double, unit string, reported_pct double"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("panelwright-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def long_df(spark):
    return spark.createDataFrame(OBSERVATIONS, SCHEMA)


@pytest.fixture(scope="session")
def panel(long_df):
    from panelwright.operators.panel import comparison_panel

    return comparison_panel(long_df, 2024, 2025)
