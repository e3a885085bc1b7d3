"""Word lists, patterns and limits that results depend on, in natural order."""

# Departments: canonical spellings, and the ones that are written otherwise too.
DEPARTMENTS = (
    "Amazonas", "Áncash", "Apurímac", "Arequipa", "Ayacucho", "Cajamarca", "Callao", "Cusco", "Huancavelica", "Huánuco",
    "Ica", "Junín", "La Libertad", "Lambayeque", "Lima", "Lima Metropolitana", "Lima Provincias", "Loreto", "Madre de Dios",
    "Moquegua", "Pasco", "Piura", "Puno", "San Martín", "Tacna", "Tumbes", "Ucayali", "Multirregional", "Multidepartamental", "Nacional",
)
DEPARTMENT_VARIANTS = {"CUZCO": "Cusco"}

# Words that mark mining, and metals that count as whole words only.
MINING_TERMS = (
    "mina", "minas", "minera", "minero", "mineras", "mineros", "mineria", "concesion minera", "tajo", "relave", "relaves",
    "campamento minero", "unidad minera", "proyecto minero", "exploracion minera", "hidrocarburo", "hidrocarburos", "petroleo",
    "camisea", "gasoducto", "dorato", "antamina", "yanacocha", "las bambas", "southern", "chinalco", "barrick",
)
METALS = ("oro", "cobre", "zinc", "plata")
MINISTRY = r"\benergia(?:\s+y|\s*,\s*|\s+e\s+)\s*minas\b|\bminem\b"
SOCIAL_SPELLINGS = ("socioambiental", "socio ambiental", "sociambiental")

# Words that a case key leaves out.
STOPWORDS = ("el", "la", "los", "las", "de", "del", "y", "en", "por", "con", "a", "un", "una", "que", "se", "al")

# Types in compact tables.
LATENT_TYPES = (
    "socioambiental", "sociambiental", "asuntos de gobierno local", "asuntos de gobierno nacional", "asuntos de gobierno regional",
    "asunto de gobierno local", "asunto de gobierno nacional", "demarcacion territorial", "demarcación territorial", "comunal", "laboral",
    "por asuntos de gobierno local", "por asuntos de gobierno nacional", "por asuntos de gobierno regional",
    "de asuntos de gobierno nacional", "de asuntos de gobierno local", "otros",
)

# Standard types: the first phrase that the folded type contains decides.
TYPE_RULES = (
    ("socioambiental", "SOCIOAMBIENTAL"), ("socio ambiental", "SOCIOAMBIENTAL"), ("laboral", "LABORAL"), ("gobierno local", "GOBIERNO LOCAL"),
    ("gobierno regional", "GOBIERNO REGIONAL"), ("gobierno nacional", "GOBIERNO NACIONAL"), ("demarcacion", "DEMARCACION TERRITORIAL"),
    ("comunal", "COMUNAL"), ("electoral", "ELECTORAL"), ("coca", "CULTIVO ILEGAL DE COCA"), ("otro", "OTROS"),
)

# Mines: name, company, aliases as folded text.
MINES = (
    ("Yanacocha", "Newmont", ("yanacocha", "quilish", "choropampa", "minera yanacocha")),
    ("Cerro Corona", "Gold Fields", ("cerro corona", "gold fields", "goldfields", "gold fields la cima", "la cima s.a", "la cima sa")),
    ("Antamina", "Antamina", ("antamina",)),
    ("Las Bambas", "Las Bambas", ("las bambas", "bambas", "mmg", "challhuahuacho", "fuerabamba")),
    ("Antapaccay", "Antapaccay", ("antapaccay", "tintaya", "xstrata")),
    ("Toromocho", "Chinalco", ("toromocho", "chinalco", "morococha")),
    ("Quellaveco", "Angloamerican", ("quellaveco", "anglo american", "angloamerican")),
    ("Atacocha", "Nexa Resources", ("atacocha", "milpo")),
    ("Chungar", "Volcan", ("chungar", "animon")),
    ("Pucamarca", "Minsur", ("pucamarca",)),
    ("Pierina", "Barrick", ("pierina", "misquichilca")),
    ("San Nicolas", "San Nicolas", ("san nicolas",)),
    ("Toquepala", "Southern", ("toquepala",)),
    ("Cuajone", "Southern", ("cuajone",)),
    ("Shougang", "Shougang", ("shougang", "hierro peru")),
)
#: This company is added when it is named together with one of these mines.
PARTNER, PARTNER_MINES = "Glencore", ("Antapaccay", "Las Bambas")

# Months by full name and abbreviation.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9,
    "octubre": 10, "noviembre": 11, "diciembre": 12, "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8,
    "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12,
}
REPORT_NUMBERS = (1, 320)

# Page headers: phrases, and whole texts.
HEADER_PHRASES = (
    "reporte mensual de conflictos", "reporte de conflictos sociales n", "adjuntia para la prevencion", "subadjuntia para la prevencion",
    "direccion de la unidad de conflictos",
)
HEADER_TEXTS = ("descripcion", "hechos del mes", "estado actual", "descripcion hechos del mes", "descripcion estado actual", "n", "departamento")
BADGES = ("caso nuevo", "caso reactivado", "hay dialogo", "no hay dialogo")
RUNNING_TITLES = (
    "anexo", "descripcion de los conflictos", "conflictos activos", "conflictos latentes", "conflictos resueltos", "conflictos concluidos",
    "conflictos vigentes", "nuevos casos", "1. nuevos casos", "2. conflictos vigentes", "3. conflictos concluidos",
)
STOP_HEADINGS = (
    r"acciones colectivas de protesta", r"hechos de violencia contra la vida", r"actuaciones defensoriales", r"acciones de violencia subversiva",
    r"alertas tempranas", r"otros indicadores", r"casos en observaci[oó]n", r"forma de resoluci[oó]n",
    r"n\.?\s*°?\s*fecha\s+medida\s+actores", r"n\.?\s*°?\s*lugar\s+caso\s+motivo",
)
CLOSING_HEADINGS = (
    r"casos en observaci[oó]n", r"conflictos(?:\s+\w+){0,4}\s+resueltos", r"conflictos que han pasado", r"forma de resoluci[oó]n",
    r"acciones colectivas de protesta", r"hechos de violencia", r"actuaciones defensoriales",
)
GARBAGE_STARTS = ("y fecha de inicio", "ultimos acontecimientos", "ubicacion autoridad", "motivo y fecha")
TABLE_STARTS = ("n ubicacion", "n fecha", "denominacion del caso", "la defensoria del pueblo", "lugar caso", "forma de resolucion")
INSTITUTION_START = "defensoria del pueblo"
LABELS = (
    "tipo", "caso", "ubicaci[oó]n", "ingres[oó]", "c[oó]digo", r"actores?\s+primarios?", r"actores?\s+secundarios?", r"actores?\s+terciarios?",
    r"actores\b", "hechos", "antecedentes", "autoridad", "poblaci[oó]n", "motivo", "fecha", "cuestionamiento",
)
CASE_LIMIT, RAW_LIMIT, CELL_LIMIT = 2500, 12000, 32767
FLOW_LAYOUTS = ("lista_narrativa_2004", "reporte_n_tabla_regiones", "unidad_reporte_n")
COLUMN_LAYOUTS = ("unidad_sumilla", "adjuntia_portada_estadistica", "infografia_ciclo_2024")

# Titles of monthly reports, and of other publications.
NUMBER_MARK = r"(?iu)n[°ºo.\s-]*\s*(\d{1,3})\b"
TITLE_YES = r"reporte\s+(mensual\s+de\s+)?conflictos\s+sociales"
TITLE_NO = r"crisis\s+pol[ií]tica|igualdad\s+y\s+no\s+violencia|personas\s+defensoras|mapas?\s+de\s+la\s+corrupci|espacios\s+anticorrupci|derecho\s+a\s+la\s+salud"

# The record that a summary model returns.
RECORD_FIELDS = ("resumen", "empresa", "mineral", "comunidades", "demanda_principal", "tipo_normalizado", "confianza", "texto_ilegible")
RECORD_TYPES = ("socioambiental", "laboral", "comunal", "gobierno_local", "gobierno_nacional", "demarcacion", "otros")
CONFIDENCES = ("alta", "media", "baja")
YES_WORDS = ("true", "1", "si", "sí", "yes")
ILLEGAL = r"\b(?:mineria ilegal|minero ilegal|mineros ilegales|extraccion ilegal|ilegal)\b"
INFORMAL = r"\b(?:informal|informales|mineria informal|minero informal)\b"

#: Columns of the case panel.
PANEL = (
    "caso_id", "numero_reporte", "anio", "mes", "formato", "archivo", "departamento", "estado", "tipo", "codigo", "ingreso_como", "caso",
    "ubicacion", "actores_primarios", "actores_secundarios", "actores_terciarios", "actores", "hechos_del_mes", "es_socioambiental",
    "menciona_mineria", "caso_estandarizado", "texto_crudo", "pagina",
)

# Numbers in the names of stored files, and the phrases of layout families with the length of text they must stand in (0: all).
STORE_PREFIX = r"^n\d{1,3}_"
STORE_NUMBERS = (r"(?:^|[-_\s])n[o.\s_-]*(\d{1,3})(?!\d)", r"conflictos(?:[_\s-]*sociales)?[_\s-]*(\d{1,3})\b", r"reporte[-_\s]*(\d{1,3})\b")
STORE_LIMITS = (320, 320, 269)
STORE_OTHERS = ("adjuntia", "costos-del-conflicto", "costos_del_conflicto")
LAYOUT_PHRASES = {
    "k_intensity": (0, ("distinta intensidad",)),
    "k_unit": (3000, ("unidad de conflictos",)),
    "k_direction": (3000, ("direccion de la unidad",)),
    "k_deputy": (4000, ("adjuntia", "subadjuntia")),
    "k_summary": (2500, ("sumilla",)),
    "k_special": (2000, ("reporte especial",)),
    "k_cycle": (4000, ("fase temprana", "desescalamiento")),
}
