"""Rule tables used by the jobs: procedural classes, courts, states, laws, confidence profiles.

Everything here is data.  The tables are small and of fixed size, so the jobs embed them as literals
(`create_map`, regex alternations); they never grow with the input.
"""

# Court acronyms and state (UF) codes.
COURTS = ["STF", "STJ", "TST", "TSE", "STM"]
COURT_TITLES = {
    "STF": "supremo tribunal federal", "STJ": "superior tribunal de justiça", "TST": "tribunal superior do trabalho",
    "TSE": "tribunal superior eleitoral", "STM": "superior tribunal militar",
}
UFS = ["AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB",
       "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO"]

# State names (accents removed, upper case) and their codes.
STATES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA",
    "CEARA": "CE", "DISTRITO FEDERAL": "DF", "ESPIRITO SANTO": "ES", "GOIAS": "GO",
    "MARANHAO": "MA", "MATO GROSSO DO SUL": "MS", "MATO GROSSO": "MT", "MINAS GERAIS": "MG",
    "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR", "PERNAMBUCO": "PE", "PIAUI": "PI",
    "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS",
    "RONDONIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC", "SAO PAULO": "SP",
    "SERGIPE": "SE", "TOCANTINS": "TO",
}

# Letters that OCR puts in place of digits, and the digit each stands for.
OCR_LETTERS = "OoQDlLIi|!SsgqGbBZz"
OCR_LETTER_DIGITS = "0000111111559966822"

# How scanned texts show a lower-case letter of running text, and accents that come and go.
OCR_CONFUSIONS = {"a": ["á", "à", "â", "ã"], "e": ["é", "ê", "c"], "i": ["í", "l", "1"], "o": ["ó", "ô", "õ", "0"], "u": ["ú"],
                  "l": ["1", "I", "|"], "s": ["5", "$"], "m": ["rn"], "ç": ["c"]}

# Words that citations are made of.
SUMULA_HEADS = ["súmula", "súm", "verbete", "enunciado"]
SUMULA_HEADS_PLURAL = ["súmulas", "enunciados", "verbetes"]
SUMULA_QUALIFIERS = ["vinculante", "dominante"]
COURT_HONOURS = ["c.", "e.", "egrégio", "colendo"]
THEME_SUBJECTS = ["repercussão geral", "recurso repetitivo", "recursos repetitivos"]
DECISION_HEADS = ["julgado", "julgada", "precedente", "acórdão", "aresto", "decisão", "voto"]

# OCR swaps undone inside words, in the order they are tried (seen, meant).
WORD_SWAPS = [("0", "O"), ("5", "S"), ("1", "L"), ("1", "I"), ("L", "I"), ("I", "L"), ("C", "E"), ("RN", "M")]

# Zero-width characters dropped, and characters unified one to one, before detection.
INVISIBLE_CHARS = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
HYPHEN_CHARS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
DOUBLE_QUOTE_CHARS = "\u201c\u201d\u201e"
SINGLE_QUOTE_CHARS = "\u2018\u2019\u00b4"

# Spellings of the procedural classes over prepared text (no accents, upper case) and the
# acronyms each stands for.  The order matters: longer names come before the parts they are made of.
CLASS_SPELLINGS = [
    (["AREspE"], ["AGRAVO EM RECURSO ESPECIAL ELEITORAL", "ARESPEL", "ARESPE"]),
    (["REspE"], ["RECURSO ESPECIAL ELEITORAL", "RECUR ESPECIAL ELEITORAL", "RESPEL", "RESPE"]),
    (["EDiv", "AREsp"], ["EMBARGOS DE DIVERGENCIA EM AGRAVO EM RECURSO ESPECIAL", "EARESP"]),
    (["EDiv", "REsp"], ["EMBARGOS DE DIVERGENCIA EM RESP", "EMBARGOS DE DIVERGENCIA EM RECURSO ESPECIAL", "ERESP"]),
    (["AREsp"], ["AGRAVOS EM RECURSOS ESPECIAIS", "AGRAVO EM RECURSO ESPECIAL", "ARESPS", "ARESP", "AG RESP",
                 "AGRESP"]),
    (["REsp"], ["RECURSOS ESPECIAIS", "RECURSO ESPECIAL", "RESPS", "RESP", "REC ESP", "R ESP"]),
    (["ARE"], ["RECURSO EXTRAORDINARIO COM AGRAVO", "ARE"]),
    (["RE"], ["RECURSO EXTRAORDINARIO", "RE"]),
    (["RHC"], ["RECURSO EM HABEAS CORPUS", "RECURSO ORDINARIO EM HABEAS CORPUS", "RHC"]),
    (["HC"], ["HABEAS CORPUS", "H C", "HC"]),
    (["RMS"], ["RECURSO ORDINARIO EM MANDADO DE SEGURANCA", "RECURSO ORD EM MANDADO DE SEGURANCA",
               "RECURSO EM MANDADO DE SEGURANCA", "RMS"]),
    (["MS"], ["MANDADO DE SEGURANCA", "MS"]),
    (["Rcl"], ["RECLAMACAO", "RECL", "RCL"]),
    (["AR"], ["ACAO RESCISORIA", "AR"]),
    (["CC"], ["CONFLITO DE COMPETENCIA", "CC"]),
    (["SLS"], ["SUSPENSAO DE LIMINAR E DE SENTENCA", "SLS"]),
    (["SS"], ["SUSPENSAO DE SEGURANCA", "SS"]),
    (["SL"], ["SUSPENSAO DE LIMINAR", "SL"]),
    (["APn"], ["ACAO PENAL", "APN", "AP"]),
    (["ADO"], ["ACAO DIRETA DE INCONSTITUCIONALIDADE POR OMISSAO", "ADO"]),
    (["ADI"], ["ACAO DIRETA DE INCONSTITUCIONALIDADE", "ADI"]),
    (["ADPF"], ["ARGUICAO DE DESCUMPRIMENTO DE PRECEITO FUNDAMENTAL", "ADPF"]),
    (["ADC"], ["ACAO DECLARATORIA DE CONSTITUCIONALIDADE", "ADC"]),
    (["ACO"], ["ACAO CIVEL ORIGINARIA", "ACO"]),
    (["MI"], ["MANDADO DE INJUNCAO", "MI"]),
    (["Inq"], ["INQUERITO", "INQ"]),
    (["STA"], ["SUSPENSAO DE TUTELA ANTECIPADA", "STA"]),
    (["HDE"], ["HOMOLOGACAO DE DECISAO ESTRANGEIRA", "HDE"]),
    (["SEC"], ["SENTENCA ESTRANGEIRA CONTESTADA", "SEC"]),
    (["CR"], ["CARTA ROGATORIA", "CR"]),
    (["IDC"], ["INCIDENTE DE DESLOCAMENTO DE COMPETENCIA", "IDC"]),
    (["PUIL"], ["PEDIDO DE UNIFORMIZACAO DE INTERPRETACAO DE LEI", "PUIL"]),
    (["CauInomCrim"], ["CAUTELAR INOMINADA CRIMINAL"]),
    (["Pet"], ["PETICAO", "PET"]),
    (["AIRR"], ["AGRAVO DE INSTRUMENTO EM RECURSO DE REVISTA", "AIRR"]),
    (["ARR"], ["RECURSO DE REVISTA COM AGRAVO", "ARR", "RRAG"]),
    (["RO"], ["RECURSO ORDINARIO TRABALHISTA", "ROT"]),
    (["RR"], ["RECURSO DE REVISTA", "RR"]),
    (["R", "Rp"], ["RECURSO NA REPRESENTACAO", "R RP"]),
    (["Rp"], ["REPRESENTACAO", "RP"]),
    (["RO"], ["RECURSO ORDINARIO ELEITORAL", "RECURSO ORDINARIO", "RO"]),
    (["RCED"], ["RECURSO CONTRA EXPEDICAO DE DIPLOMA", "RCED"]),
    (["AIJE"], ["ACAO DE INVESTIGACAO JUDICIAL ELEITORAL", "AIJE"]),
    (["PC"], ["PRESTACAO DE CONTAS", "PC"]),
    (["TutCautAnt"], ["TUTELA CAUTELAR ANTECEDENTE", "TUTCAUTANT"]),
    (["AC"], ["ACAO CAUTELAR", "AC"]),
    (["LT"], ["LISTA TRIPLICE", "LT"]),
    (["AI"], ["AGRAVO DE INSTRUMENTO", "AI"]),
    (["Apl"], ["APELACAO CRIMINAL", "APELACAO", "APL"]),
    (["RSE"], ["RECURSO EM SENTIDO ESTRITO", "RSE"]),
    (["EIN"], ["EMBARGOS INFRINGENTES E DE NULIDADE", "EIN"]),
    (["CJ"], ["CONFLITO DE JURISDICAO", "CJ"]),
    (["CP"], ["CORREICAO PARCIAL MILITAR", "CORREICAO PARCIAL", "CP"]),
    (["Incomp"], ["INCOMPATIBILIDADE"]),
    (["AgInt"], ["AGRAVO INTERNO", "AGINT", "AG INT"]),
    (["AgRg"], ["AGRAVO REGIMENTAL", "AGRG", "AG REG", "AGR"]),
    (["ED"], ["EMBARGOS DE DECLARACAO CRIMINAL", "EMBARGOS DE DECLARACAO", "EMB DECL", "EDCL", "EDCIV", "EDS", "ED"]),
    (["EDiv"], ["EMBARGOS DE DIVERGENCIA", "EMB DIV", "EDV"]),
    (["E"], ["EMBARGOS", "EMB", "E"]),
    (["Ag"], ["AGRAVO", "AG"]),
    (["QO"], ["QUESTAO DE ORDEM", "QO"]),
    (["Ref"], ["REFERENDO"]),
    (["PExt"], ["PEXT"]),
]

# Words that link the parts of a class and carry no information.
IGNORABLE_WORDS = ["NO", "NA", "NOS", "NAS", "EM", "DE", "DO", "DA", "N", "O", "A", "AO", "TST", "CRIMINAL",
                   "CIVEL", "SUPERIOR", "TRIBUNAL", "MILITAR"]
IGNORABLE_ORDINALS = "(?:SEGUND|TERCEIR|QUART|QUINT|DECIM)[OA]S?"
# Words known besides those of the spellings and the ignorable ones.
EXTRA_KNOWN_WORDS = ["SEGUND", "TERCEIR", "QUART", "QUINT", "DECIM", "OA", "S", "STF", "STJ", "TSE", "TST", "STM",
                     "PROCESSO", "PROC"]
NEUTRAL_WORDS = COURTS + ["PROCESSO", "PROC"]

CLASS_VOCABULARY = sorted({w for _, sp in CLASS_SPELLINGS for s in sp for w in s.split(" ")}
                          | set(IGNORABLE_WORDS) | set(EXTRA_KNOWN_WORDS))

# Courts in which each base class exists.
CLASS_COURTS = {
    "REsp": ["STJ"], "AREsp": ["STJ"], "RHC": ["STJ", "STF"], "RMS": ["STJ", "STF"],
    "HC": ["STJ", "STF", "STM"], "MS": ["STJ", "STF"], "Rcl": ["STF", "STJ"],
    "AR": ["STJ", "STF"], "CC": ["STJ"], "SLS": ["STJ"], "SS": ["STJ"], "APn": ["STJ", "STF"],
    "Pet": ["STJ", "STF"], "CauInomCrim": ["STJ"],
    "RE": ["STF"], "ARE": ["STF"], "ADI": ["STF"], "ADO": ["STF"], "ADPF": ["STF"], "ADC": ["STF"],
    "ACO": ["STF"], "MI": ["STF", "STJ"], "Inq": ["STF", "STJ"], "SL": ["STF", "STJ"], "STA": ["STF", "STJ"],
    "HDE": ["STJ"], "SEC": ["STJ", "STF"], "CR": ["STJ", "STF"], "IDC": ["STJ"], "PUIL": ["STJ"],
    "RR": ["TST"], "AIRR": ["TST"], "ARR": ["TST"],
    "REspE": ["TSE"], "AREspE": ["TSE"], "Rp": ["TSE"], "RO": ["TSE"], "AI": ["TSE"],
    "Apl": ["STM"], "RSE": ["STM"], "EIN": ["STM"],
}
# Justice digit of a CNJ number and the superior court it belongs to.
JUSTICE_COURT = {"1": "STF", "3": "STJ", "5": "TST", "6": "TSE", "7": "STM"}

# Public names and acronyms of laws (no accents, lower case) and their codes.
LAW_ALIASES = {
    "cpc": "L13105", "ncpc": "L13105", "codigo de processo civil": "L13105",
    "novo codigo de processo civil": "L13105",
    "cc": "L10406", "codigo civil": "L10406",
    "clt": "DL5452", "consolidacao das leis do trabalho": "DL5452",
    "cf": "CF", "cf/88": "CF", "cf/1988": "CF", "crfb": "CF", "crfb/88": "CF",
    "constituicao federal": "CF", "constituicao da republica": "CF", "constituicao": "CF",
    "carta magna": "CF", "lei maior": "CF", "constituicao federal de 1988": "CF",
    "cpp": "DL3689", "codigo de processo penal": "DL3689",
    "cpm": "DL1001", "codigo penal militar": "DL1001",
    "cppm": "DL1002", "codigo de processo penal militar": "DL1002",
    "cp": "DL2848", "codigo penal": "DL2848",
    "cdc": "L8078", "codigo de defesa do consumidor": "L8078",
    "codigo eleitoral": "L4737",
    "ctn": "L5172", "codigo tributario nacional": "L5172",
    "eca": "L8069", "estatuto da crianca e do adolescente": "L8069",
    "lei das eleicoes": "L9504", "lei de inelegibilidades": "LC64", "lei de inelegibilidade": "LC64",
    "lei de execucao penal": "L7210", "lep": "L7210", "lei maria da penha": "L11340",
    "lei de improbidade administrativa": "L8429", "lei de improbidade": "L8429",
    "lindb": "DL4657", "lei de introducao as normas do direito brasileiro": "DL4657",
    "estatuto do idoso": "L10741", "estatuto da pessoa idosa": "L10741", "lei de drogas": "L11343",
    "lei dos juizados especiais": "L9099", "lei do mandado de seguranca": "L12016",
    "estatuto da advocacia": "L8906", "estatuto da oab": "L8906",
    "ctb": "L9503", "codigo de transito brasileiro": "L9503", "lei da acao civil publica": "L7347",
    "lgpd": "L13709", "lei geral de protecao de dados": "L13709", "marco civil da internet": "L12965",
    "estatuto do desarmamento": "L10826", "lei de falencias": "L11101", "lei do inquilinato": "L8245",
    "loman": "LC35", "lei organica da magistratura nacional": "LC35",
    "lei dos partidos politicos": "L9096", "estatuto dos militares": "L6880",
    "estatuto dos servidores publicos": "L8112", "regime juridico unico": "L8112",
}
LAW_NAME_MIN_CHARS = 10
LAW_SIMILARITY = 0.9

# Situations of a decision and the confidence each profile gives them.
CONFIDENCE = {
    "padrao": {
        "real: número único": 1.0,
        "real: número único, classe ou UF divergem": 1.0,
        "real: desempate por classe ou UF": 1.0,
        "real: lei ou súmula da base": 1.0,
        "incompleta: sem número": 1.0,
        "inventada: número ausente, texto limpo": 1.0,
        "inventada: número ausente, texto com ruído": 1.0,
        "inventada: lei ou súmula fora da base, texto limpo": 1.0,
        "inventada: lei ou súmula fora da base, texto com ruído": 1.0,
        "inventada: CNJ com DV válido, ausente": 1.0,
        "inventada: tema": 1.0,
        "inventada: número só existe em outro tribunal": 0.85,
        "incompleta: número ambíguo": 0.60,
        "incompleta: súmula sem tribunal": 0.50,
        "real: duplicata de texto idêntico": 0.50,
    },
    "conservador": {
        "real: número único": 0.98,
        "real: número único, classe ou UF divergem": 0.90,
        "real: desempate por classe ou UF": 0.93,
        "real: duplicata de texto idêntico": 0.50,
        "real: lei ou súmula da base": 0.97,
        "inventada: número ausente, texto limpo": 0.95,
        "inventada: número ausente, texto com ruído": 0.90,
        "inventada: CNJ com DV válido, ausente": 0.60,
        "inventada: número só existe em outro tribunal": 0.85,
        "inventada: lei ou súmula fora da base, texto limpo": 0.93,
        "inventada: lei ou súmula fora da base, texto com ruído": 0.88,
        "inventada: tema": 0.80,
        "incompleta: sem número": 0.95,
        "incompleta: número ambíguo": 0.60,
        "incompleta: súmula sem tribunal": 0.50,
    },
}
CONFIDENCE["um"] = {s: 1.0 for s in CONFIDENCE["padrao"]}

# Which detector wins when spans overlap (lower first), and the constants of the metric.
KIND_PRIORITY = {"incompleta": 0, "sumula": 1, "artigo": 1, "tema": 1, "acordao": 2}
LABELS = ["real", "inventada", "incompleta"]
LEVEL_WEIGHTS = {1: 1.0, 2: 2.0}
SEVERE_WEIGHT = 0.5
BONUS_CAP = 0.10
MIN_IOU = 0.5
EXTRA_FRACTION = 0.9
ERROR_RATES = [0.0, 0.005, 0.01, 0.02, 0.05, 0.10]
