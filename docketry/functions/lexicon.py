"""Word lists, patterns, thresholds and formats that results depend on.

Patterns are for Java's regular expressions. `(?U)` makes \\s cover all Unicode blanks.
"""

from __future__ import annotations

# The bank and the operative part.
BANK_NAME = "بنك تمويل المؤسسات الصغرى والمتوسطة"
BANK_REST = r"\s+تمويل\s+(?:ا\s*)?لمؤسسات\s+الصغر[ىي]\s+(?:و\s*)?(?:ا\s*)?لمتوسط[ةه]"
BANK = rf"(?:بنك|يتنك|البنك){BANK_REST}"
#: The same mentions from two letters that all of them have: a search compares one letter a place, and not three. It ends where BANK does.
MENTION = rf"نك(?<=بنك|يتنك){BANK_REST}"
REASONS_HEADING = "ولهذه الأسباب"
REASONS = r"(?:و\s*)?ل[هي]ذه\s+ال[اأإآ]?(?:سباب|صباب)"
RULED = r"قضت\s+المحكمة"
PARAGRAPH_END = r"\n\s*\|?\s*وحرر\b|\n\s*حرر\b"
COSTS = (r"عن\s+الطور\s+الحالي", r"عن\s+الطور\s+الاستئنافي", r"عن\s+الطور\s+الإستئنافي")
FINAL_GROUNDS = r"(?:ول?هذه\s+الأسباب|قضت\s+المحكمة)"
PAGE_MARKER = r"---\s*Page\s*\d+\s*---"

# Null words and enumerations.
NULL_WORDS = ("null", "inconnu", "inconnue", "non mentionne", "non mentionnee", "absent", "absente", "n/a", "indetermine", "indeterminee")
DECISIONS = ("Favorable", "Defavorable", "Partiellement favorable")
JUDGMENT_TYPES = ("confirmatif", "modificatif", "infirmatif", "original")
ROLES = ("demandeur", "defendeur", "appelant", "intime")
STATUSES = ("Valide", "En cours", "Anomalie")

# Amounts.
ARABIC_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
VARIABLE_WORDS = ("بداية من", "الى تمام الوفاء", "إلى تمام الوفاء", "الى تمام الدفع", "إلى تمام الدفع", "جاري على", "الجاري", "الجارية", "نسبة", "%")
INTEREST_LABEL = r"^(?:الفائض|فائض|الفائدة|الفوائد|فوائد)"
AMOUNT_ANCHORS = (r"المبالغ\s+المالية\s+التالية\s*:", r"المبالغ\s+التالية\s*:")
AMOUNT_LIST_END = r"\n\s*وبعد\s+"
PLAINTIFF_BANK = r"للبنك\s+المدعي|للبنك\s+في\s+شخص|البنك\s+المدعي"
DELAY_INTEREST = r"فائض\s+الت[اأ]خير"
DINAR = "دينار"
PROCEDURE_ADVANCE = r"(?:تسبقة\s+)?مبلغ\s+(?:قدره\s+)?خمسمائة\s+دينار\s*\(500[.,]000\)"

# Months by number, both naming traditions.
MONTHS = {
    "جانفي": 1, "يناير": 1, "فيفري": 2, "فبراير": 2, "مارس": 3, "أفريل": 4, "ابريل": 4, "ماي": 5, "مايو": 5, "جوان": 6, "يونيو": 6,
    "جويلية": 7, "يوليو": 7, "أوت": 8, "اغسطس": 8, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12,
}

# Facts.
TUNIS_COURT = r"(المحكمة\s+(?:الابتدائية|الإبتدائية)\s+بتونس)"
FIRST_INSTANCE = r"(المحكمة\s+(?:الابتدائية|الإبتدائية)\s+ب?[ء-ي]{2,})"
CASE_NUMBER = r"([0-9]{1,8}(?:[./][0-9]{2,4})?)"
CASE_LEADS = (r"قضية\s+عدد\s*[:：]?\s*", r"عدد\s+القضية\s*[:：]?\s*", r"القضية\s+عدد\s*[:：]?\s*", r"رسمت\s+القضية[\s\S]{0,120}?تحت\s+عدد\s*", r"ملف\s+القضية[\s\S]{0,120}?عدد\s*")
RULINGS = (
    ("infirmatif", r"بنقض|بإلغاء|بالغاء|بفسخ|إبطال\s+الحكم|ابطال\s+الحكم"),
    ("modificatif", r"بتعديل|تعديل\s+الحكم|مع\s+تعديله|فيما\s+زاد|فيما\s+نقص"),
    ("confirmatif", r"بإقرار|بالإقرار|بتأييد|بتاييد|المصادقة\s+على\s+الحكم|إقرار\s+الحكم|تأييد\s+الحكم"),
)
#: Role, words before the bank, words after it; tried in this order.
ROLE_CUES = (
    ("appelant", r"(?:استئناف|طعن|تعقيب)", None),
    ("appelant", None, r"(?:استأنف|استانف|طعن|عقب)"),
    ("intime", r"(?:المستأنف\s+ضده|المستانف\s+ضده|المطعون\s+ضده|المعقب\s+ضده)", None),
    ("demandeur", r"(?:المدعي|القائم|الطالب|الدائن)", None),
    ("demandeur", None, r"(?:المدعي|القائم|الطالب|الدائن)"),
    ("defendeur", r"(?:المدعى\s+عليه|المطلوب|المطلوب\s+ضده)", None),
    ("defendeur", None, r"(?:المدعى\s+عليه|المطلوب|المطلوب\s+ضده)"),
)
ROLE_REACH = 120
AWARDED = ("بإلزام", "بالزام", "بأداء", "بالاداء")
FAVOURABLE = rf"قضت\s+المحكمة[\s\S]{{0,350}}?(?:{'|'.join(AWARDED)})"
DEFENDANT_MARKERS = (r"المدع(?:ى|ي)\s+(?:عليها|علها|عليه|عله)", r"المطلوب(?:ة|ة\s+ضدها)?")
COMPANY = r"(شركة\s+[^\n«»\".]{2,180})"
COMPANY_END = r"في\s+شخص|شركة\s+ذات|معرفها|المعرف"
#: With or without its ال, which is not part of the match.
ARTICLE = r"فصل\s+(\d{1,4})(?=\s|[.,:؛]|$)"
LOAN_CONTRACT = "من عقد القرض"

# Misread plural of "articles" and the anchors of structured lines.
MISREAD_ARTICLES = r"الف(?:يول|يتول|يصول|صرول|صسول)(?=\s*\d)"
ARTICLES = "الفصول"
STRUCTURED_ANCHOR = r"القضي[ةه]|تاريخ|المحكم[ةه]|المدع[ىي]|تمويل|المؤسسات|قضت|ل[هي]ذه|أسباب|المبالغ\s+المالية"

# Thresholds.
REPEATED_SHARE, BAD_TOKEN_SHARE, ARABIC_DOUBLE_SHARE = 0.08, 0.20, 0.025
MIN_PAGE_CHARS = 20
WORDS_SHARE, CONFIDENCE_BAND = 0.85, 2.0
AMOUNT_REACH, GROUNDS_REACH, LIST_REACH, PREFIX_REACH = 750, 6500, 1800, 1200
MIN_SUMMARY_SENTENCES = 5

# Sentences of explanations and summaries.
SUMMARY_BANKRUPTCY = ("تفليس", "قضت المحكمة بتفليس الشركة موضوع الإشعار واعتبارها متوقفة عن الدفع.")
SUMMARY_2019 = ("2019", "اعتمد الحكم توقف الشركة عن النشاط منذ سنة 2019 كعنصر مهم في تقدير وضعيتها المالية.")
SUMMARY_SOCIAL_FUND = ("الصندوق الوطني للضمان الاجتماعي", "كما أشار الحكم إلى ديون أخرى منها دين الصندوق الوطني للضمان الاجتماعي وديون جبائية.")
SUMMARY_TRUSTEE = (("أمين", "الفلسة"), "عينت المحكمة قاضيا منتدبا وأمينا للفلسة لاتخاذ إجراءات الإشهار والإشراف على أموال الشركة.")
SUMMARY_ADVANCE = ("500.000", "ألزم الحكم الدائنين بتسبقة خمسمائة دينار لأمين الفلسة لمباشرة المهام الإجرائية.")
ADVANCE_NOTE = "يتضمن الحكم كذلك تسبقة قدرها خمسمائة دينار (500.000) لأمين الفلسة لمباشرة الإشهارات والمهام المنوطة بعهدته، وهي مصاريف إجرائية وليست أصل مديونية بنك تمويل المؤسسات الصغرى والمتوسطة."
VARIABLE_REASON = "مبلغ متغير مرتبط بفائض أو فائدة جارية إلى تمام الوفاء، لذلك لا يضاف إلى مجموع المبالغ الثابتة."
FIXED_REASON_ORIGINAL = "مبلغ ثابت وارد ضمن المنطوق النهائي للحكم لفائدة البنك المدعي."
FIXED_REASON_CONFIRMED = "مبلغ ثابت وارد ضمن قائمة المبالغ المحكوم بها للبنك المدعي في الحكم الابتدائي الذي أقرته محكمة الاستئناف."
RECOVERED_LABEL = "فائض التأخير الاتفاقي المحتسب"
LIST_SOURCE_ORIGINAL = "تم اعتماد قائمة المبالغ الواردة في المنطوق النهائي للحكم. "
LIST_SOURCE_CONFIRMED = "الحكم الحالي أقر الحكم الابتدائي، لذلك تم اعتماد قائمة المبالغ المالية الواردة في الحكم الابتدائي المؤيد. "
VARIABLE_EXCLUDED = " وتم استبعاد الفائض أو الفائدة الجارية لأنها متغيرة وغير محددة القيمة النهائية في الحكم."
NEAREST_EXPLANATION = (
    "يمثل مبلغ ",
    " مديونية الشركة تجاه بنك تمويل المؤسسات الصغرى والمتوسطة كما ورد في نص الحكم ضمن الديون المتخلدة بذمة الشركة. "
    "اعتمد الحكم هذا المبلغ في سياق تقييم الوضعية المالية للشركة، حيث تبين أن ديونها وتعهداتها تفوق رأس مالها وأنها متوقفة عن النشاط والدفع.",
)

# Excerpts for a model, report labels, service errors (exception, status, code) and what callers see.
SHORTENED = "\n[… extrait raccourci …]\n"
EXCERPTS = (("dispositif final", 1500), ("en-tete et parties", 1100), ("contexte banque 1", 400), ("contexte banque 2", 400), ("montants confirmes", 900))
REPORT_LABELS = (
    "Tribunal", "Numero du dossier", "Date de decision", "Demandeur", "Defendeur", "Banque", "Entreprise", "Montant",
    "References juridiques", "Decision", "Justification", "Resume",
)
SERVICE_ERRORS = (
    ("FileNotFoundError", 404, "FILE_NOT_FOUND"), ("ValueError", 422, "INVALID_INPUT"), ("RuntimeError", 422, "EXTRACTION_FAILED"),
    ("APITimeoutError", 504, "LLM_TIMEOUT"), ("APIConnectionError", 503, "LLM_UNAVAILABLE"), ("APIError", 502, "LLM_ERROR"),
)
PARTIAL_MESSAGE = "Extraction partielle : verification manuelle ou relance requise."
TIMEOUT_MESSAGE = "Le service d'extraction IA a depasse le delai autorise."
INTERNAL_ERROR = (500, "INTERNAL_ERROR")
CLIENT_ERRORS = {400: 422, 422: 422, 503: 503, 504: 504}
OTHER_CLIENT_ERROR = 502
