"""The Spanish legal vocabulary that classifiers, risk rules and query expansion look for (already folded)."""

from __future__ import annotations

#: Area -> (term, weight). The order of areas settles ties.
AREAS: dict[str, tuple[tuple[str, float], ...]] = {
    "contratos": (
        ("mandato", 1.0), ("arrendamiento", 1.0), ("precio", 1.0), ("sociedad", 1.0), ("socio", 1.0), ("mandatario", 1.0),
        ("comprador", 1.0), ("rescate", 1.0), ("arrendatario", 1.0), ("mandante", 1.0), ("anulacion", 1.0),
        ("contrato", 1.0), ("compre", 1.0), ("compra", 1.0), ("venta", 1.0), ("vendedor", 1.0), ("terreno", 1.5),
        ("transferencia", 1.5), ("alquiler", 1.0), ("alquile", 1.0), ("alquilar", 1.0), ("inquilino", 1.0), ("prestamo", 1.0),
        ("firme", 1.0), ("firmamos", 1.0), ("cuotas", 1.0), ("anticipo", 1.0), ("minuta", 1.0), ("incumplio", 1.0),
        ("no cumplio", 1.0), ("plazo", 1.0),
    ),
    "obligaciones": (
        ("prestacion", 1.0), ("recibo", 1.0), ("novacion", 1.0), ("moneda", 1.0), ("mancomunidad", 1.0), ("gestor", 1.0),
        ("garantia", 1.0), ("deuda", 1.0), ("debe", 1.0), ("me debe", 1.0), ("pagar", 1.0), ("pago", 1.0),
        ("no me paga", 1.0), ("cobrar", 1.0), ("plazo vencido", 1.0), ("intereses", 1.0), ("garante", 1.0), ("fiador", 1.0),
    ),
    "derechos_reales": (
        ("obra", 1.0), ("agua", 1.0), ("muro", 1.0), ("superficie", 1.0), ("fundo", 1.0), ("medianeria", 1.0),
        ("acueducto", 1.0), ("servidumbre", 1.0), ("arbol", 1.0), ("distancia", 1.0), ("copropietario", 1.0), ("paso", 1.0),
        ("propiedad", 1.0), ("propietario", 1.0), ("dueno", 1.0), ("posesion", 1.0), ("terreno", 1.0), ("lote", 1.0),
        ("casa", 1.0), ("vecino", 1.0), ("linde", 1.0), ("cerco", 1.0), ("usucapion", 2.0), ("anticretico", 1.0),
        ("hipoteca", 1.0), ("invadio", 1.0), ("construyo", 1.0),
    ),
    "sucesiones": (
        ("legado", 1.0), ("conyuge", 1.0), ("colacion", 1.0), ("ascendiente", 1.0), ("descendiente", 1.0), ("acrecimiento", 1.0),
        ("legatario", 1.0), ("desheredacion", 1.0), ("indignidad", 1.0), ("conviviente", 1.0), ("herencia", 2.0), ("heredero", 2.0),
        ("heredar", 1.0), ("fallecio", 1.0), ("murio", 1.0), ("difunto", 1.0), ("testamento", 2.0), ("legitima", 1.0),
        ("sucesion", 1.0), ("reparto de bienes", 1.0), ("papa fallecio", 1.0),
    ),
    "responsabilidad_civil": (
        ("dano", 1.0), ("perjuicio", 1.0), ("culpa", 1.0), ("dolo", 1.0), ("resarcimiento", 1.0), ("ilicito", 1.0),
        ("indemnizacion", 1.5), ("responsabilidad", 1.0), ("dano moral", 1.0), ("choque", 1.0), ("chocaron", 1.0),
        ("accidente", 1.0), ("lesiones", 1.0), ("me perjudico", 1.0), ("negligencia", 1.0),
    ),
}
AREA_THRESHOLD = 1.0

#: Type of document -> (term, weight).
TYPES: dict[str, tuple[tuple[str, float], ...]] = {
    "compraventa": (
        ("compraventa", 2.0), ("vendedor", 2.0), ("comprador", 2.0), ("precio de venta", 1.0), ("transferencia", 1.0), ("tradicion", 1.0),
        ("minuta de transferencia", 1.0), ("bien inmueble", 1.0), ("precio convenido", 1.0), ("saneamiento de ley", 1.0), ("folio real", 1.0), ("matricula", 1.0),
    ),
    "arrendamiento": (
        ("arrendamiento", 2.0), ("arrendador", 2.0), ("arrendatario", 2.0), ("canon", 1.5), ("alquiler", 1.0), ("mensualidad", 1.0),
        ("inmueble arrendado", 1.0), ("plazo del contrato", 1.0), ("deposito en garantia", 1.0), ("entrega del inmueble", 1.0),
    ),
    "prestamo": (
        ("prestamo", 2.0), ("mutuo", 2.0), ("prestamista", 2.0), ("prestatario", 2.0), ("deudor", 1.0), ("acreedor", 1.0),
        ("interes", 1.0), ("tasa de interes", 1.0), ("amortizacion", 1.0), ("capital prestado", 1.0), ("pagare", 1.0), ("plazo de devolucion", 1.0),
    ),
    "acuerdo_civil": (
        ("transaccion", 2.0), ("conciliacion", 2.0), ("acuerdo transaccional", 2.0), ("las partes acuerdan", 1.0), ("de comun acuerdo", 1.0),
        ("desistimiento", 1.0), ("finiquito", 1.0), ("controversia", 1.0),
    ),
}
TYPE_THRESHOLD = 3.0
OTHER_TYPE = "otro"

#: First and last article -> area; numbers outside have none.
ARTICLE_AREAS = (
    (74, 290, "derechos_reales"), (291, 449, "obligaciones"), (450, 954, "contratos"), (955, 983, "obligaciones"),
    (984, 999, "responsabilidad_civil"), (1000, 1278, "sucesiones"),
)

#: Pattern over the folded question -> concepts.
EXPANSIONS = (
    (r"\bresponsabilidad\s+contractual\b", "responsabilidad contractual incumplimiento obligacion deudor mora resarcimiento dano perjuicios cumplimiento"),
    (r"\b(?:alquil\w*|arrend\w*|inquilin\w*|locatari\w*)\b", "arrendamiento arrendatario arrendador locacion"),
    (
        r"\b(?:alquil\w*|arrend\w*|inquilin\w*)\b.{0,400}\b(?:vend\w*|venta|enajen\w*|transferir|nuevo dueno|nuevo propietario)\b"
        r"|\b(?:vend\w*|venta|enajen\w*)\b.{0,400}\b(?:alquil\w*|arrend\w*|inquilin\w*)\b",
        "enajenacion cosa arrendada adquirente respetar arrendamiento",
    ),
    (
        r"\b(?:alquil\w*|arrend\w*|inquilin\w*)\b.{0,400}\b(?:termin\w*|desocup\w*|desaloj\w*|echar|irme|devolver el inmueble|resolver el contrato)\b"
        r"|\b(?:termin\w*|desocup\w*|desaloj\w*)\b.{0,400}\b(?:alquil\w*|arrend\w*|inquilin\w*)\b",
        "extincion arrendamiento vencimiento plazo desahucio restitucion",
    ),
    (r"\b(?:alquil\w*|arrend\w*|inquilin\w*)\b.{0,400}\b(?:un ano|dos anos|plazo|duracion|por un|contrato por)\b", "duracion arrendamiento plazo termino convenido"),
    (r"\b(?:compre|compraventa|comprador|vendedor)\b", "venta vendedor comprador obligaciones entrega transferencia"),
    (r"\bsin\s+testamento\b", "sucesion legal herencia"),
    (r"\b(?:padre|madre|papa|mama)\b.{0,50}\b(?:fallecio|murio)\b", "sucesion hijos descendientes"),
    (r"\b(?:me debe|deuda|deudor|acreedor)\b", "obligacion deudor acreedor pago cumplimiento"),
    (r"(?:vencio el plazo|vencio el termino|no me paga|no paga|se atraso|esta atrasad)", "mora requerimiento intimacion retraso incumplimiento resarcimiento"),
    (r"\b(?:preste|prestamo|prestamos|prestado|prestada)\b", "prestamo mutuo restitucion deudor acreedor obligacion"),
    (r"\b(?:repartir|reparto|particion|dividir la|division de)\b.{0,40}\b(?:casa|bienes|herencia|terreno)\b", "particion division herencia coherederos comunidad"),
    (r"\b(?:dano|dano mi|dano su|danaron|danada|perjuicio|reparacion del dano)\b", "responsabilidad hecho ilicito resarcimiento dano"),
    (r"\bservidumbre\b", "servidumbre paso ejercicio"),
)

#: Intents of a request: save, analyse, about the law, about the document. Over the folded text.
SAVE = (r"\bguard", r"\bsolo\s+(?:lo\s+)?sub", r"\bsubilo\b", r"\balmacen")
ANALYSE = (r"\banaliz", r"\brevisa(?:lo|me|r)?\s+(?:el|este|mi)\b", r"\bhace\s+el\s+analisis\b", r"\bdetecta\s+(?:los\s+)?riesgos\b")
LAW = (
    r"\bcodigo\s+civil\b", r"\bnormativa\b", r"\bnorma\b", r"\bley\b", r"\bleyes\b", r"\barticulo\b", r"\blegal(?:mente)?\b", r"\blicit",
    r"\bes\s+valid", r"\bderecho\s+boliviano\b", r"\bjuridicamente\b", r"\bcorresponde\s+legal",
)
DOCUMENT = (
    r"\beste\s+(?:documento|contrato|archivo|papel|acuerdo)\b", r"\bel\s+(?:documento|contrato|archivo|acuerdo)\b", r"\bmi\s+(?:documento|contrato|archivo|acuerdo)\b",
    r"\besta\s+clausula\b", r"\bla\s+clausula\b", r"\bclausula\s+\w+", r"\bque\s+subi\b", r"\baca\b", r"\baqui\b",
    r"\bdel\s+(?:documento|contrato)\b", r"\ben\s+el\s+(?:documento|contrato)\b",
)

#: Patterns of what is extracted from documents, with their offsets (case doesn't matter).
ENTITIES = {
    "monto_bs": (r"\bBs\.?\s*(?:\d{1,3}(?:[.,]\d{3})*|\d+)(?:[.,]\d{2})?\b",),
    "monto_usd": (r"(?:\$us\.?|USD|US\$)\s*(?:\d{1,3}(?:[.,]\d{3})*|\d+)(?:[.,]\d{2})?\b",),
    "fecha": (
        r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b",
        r"\b\d{1,2}\s+de\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\s+de\s+\d{4}\b",
    ),
    "cedula": (r"(?:C\.?\s*I\.?|c[eé]dula\s+de\s+identidad(?:\s+N[oó]\.?)?)\s*\d{4,10}(?:\s+(?:L\.?P\.?|C\.?B\.?|S\.?C\.?|O\.?R\.?|P\.?T\.?|T\.?J\.?|C\.?H\.?|B\.?E\.?|P\.?D\.?)(?:-[A-Za-z0-9]+)?)?",),
    "nit": (r"\bNIT\s*\d{8,15}\b",),
    "plazo": (r"\b(?:\d+|un|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|quince|veinte|treinta|cuarenta|cincuenta|sesenta|noventa|cien)(?:\s*\(\d+\))?\s+(?:d[ií]as?|mes(?:es)?|a[nñ]os?)\b",),
}
#: How the parties are introduced, and the ordinals of clauses.
PARTIES = r"\b(?:conste\s+por\s+el\s+presente|intervienen|suscriben|(?:que\s+)?celebran|(?:de|por)\s+una\s+parte)\b"
ORDINALS = ("primera", "segunda", "tercera", "cuarta", "quinta", "sexta", "septima", "octava", "novena", "decima", "undecima", "duodecima", "vigesima")

#: What is asked about one document, in the order in which they are tried.
DOCUMENT_INTENTS = (
    ("partes", r"\b(?:quienes|partes|comparecen|intervienen)\b"),
    ("monto", r"\b(?:cuanto|monto|precio|capital|canon)\b"),
    ("plazo", r"\b(?:plazo|duracion|vigencia)\b"),
    ("firma", r"\b(?:quien firma|quienes firman|firmantes)\b"),
    ("fecha", r"\b(?:cuando|fecha|vence|vencimiento|empieza|comienza|termina)\b"),
)

#: Theme, pattern over the folded question, pattern over the folded heading that answers it.
THEMES = (
    ("acumulacion", r"coexist|acumul|penal.*(?:gasto|da[nñ]o)|(?:gasto|da[nñ]o).*penal", r"resarcimiento convencional|prohibicion de exigencia conjunta|^resarcimiento del dano$"),
    ("saldo", r"saldo|pendiente|restante|contraprestacion", r"excepcion del incumplimiento|cumplimiento parcial"),
    ("vicios", r"vicios|defect|filtracion|ceramicas|obra.*calidad", r"vicios.*obra|obra.*vicios|recepcion de obra afectada"),
    ("proveedor", r"proveedor|causa no imputable|causa ajena", r"responsabilidad del deudor que no cumple|incumplimiento por imposibilidad"),
    ("plazo", r"plazo adicional|dias adicionales|efecto.*plazo|requerimiento", r"resolucion por requerimiento|constitucion en mora"),
    ("mora", r"\bmora\b|retras|vencim|no entreg|no pag|incumplimiento", r"constitucion en mora|mora sin intimacion|responsabilidad del deudor que no cumple"),
    ("penalidad", r"penalidad|clausula penal|pena convencional|0[,.]5%", r"resarcimiento convencional|cuantia de la pena|disminucion equitativa"),
    ("resolucion", r"resolucion|resolv|terminar contrato", r"^resolucion por incumplimiento$|^resolucion por requerimiento$|gravedad e importancia"),
    ("danos", r"\bdanos?\b|gasto adicional|resarcimiento", r"resarcimiento del dano|responsabilidad del deudor que no cumple"),
    ("informacion", r"informacion adicional|necesitari|que falta", r"$^"),
)
WEAK_WORDS = ("contrato", "derecho", "civil", "articulo", "normas")

#: Problems of a case and the pattern over the folded account.
PROBLEMS = (
    ("pago", r"no pag|falta de pago|incumpl|responsabilidad contractual"),
    ("mora", r"requerimiento|intimacion|\bmora\b"),
    ("resolucion", r"resolucion|resolver el contrato"),
    ("tercero", r"tercero|otra persona|subarrend|ceder el contrato"),
    ("modificaciones", r"modific|pared|alteracion"),
    ("danos", r"\bdanos?\b|perjuicio|resarcimiento"),
    ("penalidad", r"penalidad|clausula penal|pena convencional"),
    ("humedad", r"humedad|filtracion|inhabitable|vicios"),
    ("pruebas", r"prueba|fotograf|testimonio|comprobantes|whatsapp"),
)

#: Openings of requests, claims that widen an answer's scope.
REQUESTS = ("quiero saber", "quisiera saber", "indicame", "explicame", "necesito saber", "que obligaciones")
WIDER_CLAIMS = (r"\b(?:el contrato|el prestamo)\s+(?:empieza|comienza|inicia|termina|finaliza|vence)\b", r"todas las partes")

#: What form fields are checked against, over the folded value.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "setiembre", "octubre", "noviembre", "diciembre")
RELATIVE_DATES = r"\b(?:hoy|manana|ayer|ahora|actual|cualquiera|la de hoy|hoy dia|no se|n/?a|pendiente|a definir)\b"
NUMBER_WORDS = (
    r"\b(?:un|una|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|quince|veinte|treinta|cuarenta|cincuenta|sesenta|setenta"
    r"|ochenta|noventa|cien|ciento|mil|millon|millones|medio)\b"
)
TIME_UNITS = r"\b(?:dia|dias|semana|semanas|mes|meses|ano|anos|trimestre|semestre)\b"
CURRENCY = r"\bbs\b|bs\.|boliviano|\$|\bus\b|\bsus\b|usd|dolar|euro"
SHORT_WORDS = ("de", "del", "la", "las", "el", "los", "y", "en", "san", "santa")
AMOUNT_FIELDS, TERM_FIELDS = ("monto", "precio", "canon"), ("plazo", "plazo_devolucion")

#: What names an authority outside the sources, over the text as it is.
AUTHORITIES = (
    r"(?i)\bConstituci[oó]n\s+Pol[ií]tica(?:\s+del\s+Estado)?\b",
    r"\bCPE\b",
    r"(?i)\b(?:art[íi]culo|art\.?|arts?\.?)\s*\d+\s+(?:de\s+la\s+Constituci[oó]n|constitucional)\b",
    r"(?i)\b(?:seg[uú]n|conforme\s+a|de\s+acuerdo\s+con|surge\s+de|(?:proviene|deriva|emana)\s+de|se\s+(?:basa|fundamenta)\s+en)\s+la\s+Constituci[oó]n\b",
    r"(?i)\b(?:ley|leyes)\s+(?:n[°ºo.]?\s*\d+|n[uú]mero\s+\d+)",
    r"\bLey(?:es)?\s+de\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]+",
    r"\bLey(?:es)?\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]*",
    r"(?i)\b(?:decreto|reglamento)\s+(?:(?:supremo|ley)\s+)?(?:n[°ºo.]?\s*\d+|n[uú]mero\s+\d+)",
    r"\b(?:Decreto|Reglamento)\s+(?:Supremo|Ley|[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]*)\b",
    r"(?i)\b(?:Sentencia|Auto\s+Supremo)\s+(?:n[°ºo.]?\s*)?\d+(?:/\d+)?\b",
    r"(?i)\b(?:seg[uú]n|conforme\s+a)\s+la\s+jurisprudencia\b",
)
#: A reference to articles with its whole enumeration; numbers; names of codes; internal marks; amounts and shares.
ARTICLES = r"(?i)\b(?:art[íi]culos?|arts?\.?)\s*(?:n[°ºo.]?\s*)?(\d+(?:\s*(?:,|y|e)\s*\d+)*)"
NUMBERS = r"\b\d+(?:[.,/]\d+)*\b"
CODES = (
    r"(?i)\bc[oó]digo\s+(?:civil|penal|comercial|de\s+comercio|de\s+familia|procesal\s+\w+|de\s+procedimiento\s+\w+)(?:\s+boliviano)?\b",
    r"\bC[oó]digo\s+(?:[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]*|de\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]*)\b",
)
INTERNAL_MARK = r"\bF[1-9][0-9]*(?:C[1-9][0-9]*)?\b"
STATUS_CLAIM = r"(?i)\b(?:vigente|derogado|derogada|garantizado|garantizada)\b|<\s*/?think"
AMOUNT = r"(?i)(?:\bbs\.?|\$us|\$|\busd|\bus\$)\s*\d+(?:[.,]\d+)*|\d+(?:[.,]\d+)*\s*(?:bolivianos|d[oó]lares)"
PERCENT = r"\d+(?:[.,]\d+)*\s*%"

#: Labels of figures, by what stands before and behind them, over the folded text.
AMOUNT_LABELS = (
    ("saldo_pendiente", r"saldo|restant|pendient", r"restant|pendient|de saldo"),
    ("anticipo", r"anticipo", r"de anticipo"),
    ("gasto_adicional", r"gasto|reparacion|reparar", r"gastad|para reparar|de gasto"),
    ("precio_total", r"precio total|valor total|contrato.{0,30}por|obra.{0,20}por", None),
)
PERCENT_LABELS = (("tope_contractual", r"tope|maximo", r"tope|maximo"), ("penalidad_diaria", r"penalidad|clausula penal|pena diaria", r"diari|por (?:cada )?dia"))

#: Labels of dates, by what stands before or behind them, and terms in digits, over the folded text; months as shown.
DATE_LABELS = (
    ("fecha_entrega_pactada", r"entreg|vencim|plazo pactado"),
    ("fecha_requerimiento", r"comunicacion|requerim|intimacion|plazo adicional"),
    ("fecha_abandono", r"abandon"),
    ("fecha_contrato", r"contrat|pacto"),
)
TERM = r"\b(\d+\s+(?:dias?|meses|anos?))\b"
SHOWN_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")

#: Limitations that declare something missing, those that never say anything, and words that name nothing.
MISSING_CLAIM = (
    r"(?i)(?:no\s+(?:se\s+)?(?:conoce|consta|indica|menciona|precisa|especifica|aclara|informa|sabe|detalla|dispone\s+de|cuenta\s+con)|se\s+desconoce|falta(?:n)?\s+(?:datos?|informaci[oó]n)"
    r"|no\s+hay\s+(?:informaci[oó]n|datos?)|no\s+surge|no\s+fue\s+(?:aportad|precisad|indicad)|sin\s+informaci[oó]n\s+sobre)"
)
EMPTY_CLAIM = r"(?i)no se (?:menciona|indica|especifica) en (?:las )?fuentes c[oó]mo|no se sabe c[oó]mo se aplica (?:esta|la) norma"
EMPTY_WORDS = (
    "que los las del con por para una uno sus esta este esa ese cual cuales sobre entre sido son hay algun alguna ningun ninguna tampoco tambien exacta exacto "
    "concreta concreto detalle detalles respecto cuanto cuando existe existen existia existio hubo haya habia tiene tienen tuvo fue fueron sea sean estan estuvo "
    "consta indica menciona precisa especifica aclara informa establece incluye contiene senala define aporta presento acordo acordaron pacto pactaron corresponde aplica"
).split()

#: Requests that no source can ground; conclusions that need a reservation: theme, claim, reservation.
UNGROUNDABLE = r"invent\w*\s+(?:un\s+)?articulo|ignor\w*\s+(?:todas?\s+)?(?:las?\s+)?(?:fuentes|instrucciones)|responde\s+segun\s+lo\s+que\s+sab"
RESERVED = (
    ("proveedor", r"proveedor.{0,40}no (?:lo )?libera", r"por si solo|sin prueba|debe probar|depende", "conclusion_categorica"),
    ("acumulacion", r"(?:penalidad|pena).{0,90}(?:acumula|coexiste).{0,90}(?:gasto|dano)", r"depende|sin duplic|distinto|debe analizar", "acumulacion_no_fundada"),
)
NO_SOURCE = r"no (?:puedo|es posible|hay|se puede).{0,80}(?:fundament|conclu|fuente)|faltan? (?:fuentes|normas)"

#: A marker of a fact in a draft: role and number.
FACT_MARKER = r"\{\{([a-z_]+):(H[1-9]\d*|D[1-9]\d*)\}\}"
WRITTEN_TERM = r"(?i)\b(?:un|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|veinte|treinta|setenta)\s+(?:d[ií]as?|meses|a[nñ]os?)\b"

#: Narratives, against hypotheses, over the folded text.
HYPOTHESIS = r"\b(?:que pasa si|que ocurre si|en caso de que|supongamos que)\b"
NARRATIVE = (
    r"\b(?:mi|mis|me|nos|nuestro|nuestra|yo)\b.{0,100}\b(?:paga|pago|pague|compre|vendi|debe|deben|incumplio|firmo|firme|entrego|entregue|preste|alquilo|fallecio|reclama|demanda|demando|niega)\b"
    r"|\b(?:tengo|tenemos)\b.{0,60}\b(?:contrato|deuda|problema)\b|\b(?:compre|pague|vendi|preste|firme|alquile|recibi)\b"
)

#: When a sentence tells when something begins or ends, and what a question about it looks like.
BEGINS = (r"\b(?:empieza|comienza|inicia|inicio)\b", r"comienza|inicia|inicio")
ENDS = (r"\b(?:termina|finaliza|vence|final|vencimiento)\b", r"fecha final|vence|vencimiento|finaliza|termina")

#: Facts of a case by what stands near a figure, a share or a date, over the folded text.
CASE_AMOUNT, CASE_PERCENT = r"(?i)\bBs\.?\s*[\d.]+(?:,\d+)?", r"\d+(?:[.,]\d+)?\s*%"
CASE_DATE = r"(?i)\b\d{1,2}\s+de\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?:\s+de\s+\d{4})?\b"
CASE_TERM = r"(?i)\b(?:\d+|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez)\s+d[ií]as adicionales\b"
NEAR_AMOUNT = (("saldo_pendiente", r"saldo|restante|pendiente", True), ("anticipo", r"anticipo", True), ("gasto_adicional", r"otra empresa|terminar y reparar|gasto adicional|reparacion", False), ("precio_total", r"contrat|precio|valor total", False))
NEAR_PERCENT = (("tope_contractual", r"maximo|tope"), ("penalidad_diaria", r""))
NEAR_DATE = (("fecha_requerimiento", r"comunicacion escrita|requerimiento|intimacion"), ("fecha_abandono", r"abandon"), ("fecha_entrega_pactada", r"debia entregar|entrega.*hasta"), ("fecha_contrato", r"contrate|contrato.*por"))

#: Searches behind each problem of a case: problem, search, its words, patterns that a source must all have, pattern of its heading.
SEARCHES = (
    ("pago", "pago", "arrendatario pagar canon plazos convenidos", ("arrendatario", "canon", "paga"), "obligaciones principales"),
    ("pago", "responsabilidad", "responsabilidad deudor incumplimiento resarcimiento", ("deudor", "no cumple|incumpl", "resarc"), "responsabilidad del deudor"),
    ("mora", "mora", "constitucion mora intimacion requerimiento deudor", ("deudor", "mora", "requerimiento"), "constitucion en mora"),
    ("resolucion", "resolucion", "resolucion incumplimiento contratos reciprocas", ("contrato", "resolucion", "reciprocas"), "incumplimiento"),
    ("resolucion", "resolucion_requerimiento", "resolucion requerimiento nota notarialmente termino", ("notarial", "termino", "contrato"), "resolucion por requerimiento"),
    ("tercero", "tercero", "subarrendar ceder contrato vivienda arrendatario", ("arrendatario", "subarrend", "vivienda"), "prohibicion de subarrendar"),
    ("modificaciones", "modificaciones", "arrendatario cosa servirse uso destino diligencia", ("arrendatario", "servirse|uso", "diligencia|destino"), "obligaciones principales"),
    ("danos", "danos", "resarcimiento dano incumplimiento perdida acreedor ganancia", ("incumplimiento", "perdida", "acreedor"), "resarcimiento del dano"),
    ("penalidad", "penalidad", "clausula penal resarcimiento convencional retraso", ("clausula penal", "sustituye"), "resarcimiento convencional"),
    ("penalidad", "pena_excesiva", "disminucion equitativa pena excesiva", ("pena", "excesiva|disminuida"), "disminucion equitativa"),
    ("penalidad", "pena_limite", "cuantia pena convencional obligacion principal", ("pena convencional", "exceder"), "cuantia de la pena"),
    ("humedad", "humedad", "arrendada vicios idoneidad uso goce canon", ("arrendada", "vicios", "idoneidad"), "vicios"),
    ("humedad", "reparaciones", "arrendador mantener cosa reparaciones necesarias", ("arrendador", "reparaciones", "mantener"), "mantenimiento"),
    ("pruebas", "pruebas", "carga prueba hechos pretension excepcion", ("probar", "pretension", "excepcion"), "carga de la prueba"),
)

#: Marks of what a request asks of a report.
ASKS_GROUP = ("agrupa", "agrupá", "distribuci", "desglos", "clasificad")
ASKS_TOTAL = ("cuant", "promedio", "media de", "suma", "sumá", "total", "contar", "conteo", "maximo", "minimo")
ASKS_SHOW = (
    ("torta", ("torta", "circular", "pastel", "pie chart", "dona", "anillo")), ("barras", ("barra", "grafico", "grafica", "chart", "histograma")),
    ("resumen", ("resumime", "resumi ", "resumilo", "un resumen", "como resumen", "en resumen", "resumen de los resultados")), ("tabla", ("tabla", "listado", "listame", "en filas")),
)
ASKS_FILE = (
    ("xlsx", ("excel", "xlsx", "planilla", "hoja de calculo", "spreadsheet")), ("pptx", ("powerpoint", "power point", "pptx", "diapositiva", "presentacion", "presentación", "ppt")),
    ("docx", ("word", "docx", "documento de texto")), ("pdf", ("pdf",)),
)

#: What a question about the application wants, over the folded question, in the order in which they are tried.
HELP_INTENTS = (
    ("donde_estoy", r"\b(?:donde (?:estoy|me encuentro)|en que pantalla estoy|que pantalla es esta)\b"),
    ("capacidades_pantalla", r"\b(?:que (?:puedo|se puede) hacer|que hago)\s+(?:aqui|aca|en esta pantalla)\b"),
    ("explicar_pantalla", r"pantalla.*\b(?:explica\w*|entiendo|entender|uso|usar\w*|sirve)\b|\b(?:explica\w*|entiendo|entender|uso|usar\w*|sirve)\b.*pantalla|\bexplicame como usarla\b"),
    ("siguiente_paso", r"\b(?:siguiente paso|que sigue|que hago despues|despues de completar)\b"),
    ("obligatorio_elemento", r"\b(?:obligatori|necesari|requerid)\w*\b"),
    ("explicar_elemento", r"\b(?:que pongo|que va|que significa|para que sirve|como completo)\b"),
)
LEGAL_QUESTION = r"\b(?:es legal|es valida|validez|tengo derecho|que derechos|puedo demandar|demando|demanda contra|es licita|me pueden cobrar|corresponde una multa|que dice el codigo civil|clausula abusiva)\b"
ELSEWHERE = r"\b(?:clima|tiempo hara|pronostico|futbol|receta de cocina)\b"
COURT, SEND = r"\b(?:juzgado|tribunal)\b", r"\b(?:envi\w*|present\w*|remit\w*)\b"
HELP_STOP_ROOTS = ("donde", "cuando", "cuale", "puedo", "hacer", "sobre", "difer", "panta", "ayuda", "boton", "datos", "docum", "resul", "campo")

#: Words of a document's windows that speak of what is asked about it.
SIGNALS = {
    "partes": ("partes", "comparecen", "intervienen", "prestamista", "prestatario", "vendedor", "comprador", "arrendador", "arrendatario"),
    "plazo": ("plazo", "duracion", "vigencia", "meses", "fecha final", "vencimiento"),
    "monto": ("monto", "precio", "capital", "canon", "suma", "bs", "usd"),
    "fecha": ("fecha", "inicio", "comienza", "final", "vencimiento", "firma"),
    "firma": ("firma", "firman", "suscriben"),
}
