"""Fixed values of the synthesis normaliser, which must be as they are for equal readings: letters as a Nepali speaker
names them, general words, symbols, Latin sounds in Devanagari, signs, and the representable characters."""

LETTER_NAMES = {
    "a": "ए", "b": "बी", "c": "सी", "d": "डी", "e": "ई", "f": "एफ", "g": "जी", "h": "एच",
    "i": "आई", "j": "जे", "k": "के", "l": "एल", "m": "एम", "n": "एन", "o": "ओ", "p": "पी",
    "q": "क्यू", "r": "आर", "s": "एस", "t": "टी", "u": "यू", "v": "भी", "w": "डब्लु", "x": "एक्स",
    "y": "वाई", "z": "जेड",
}
LEXICON = {
    "ayush": "आयुष", "agni group": "अग्नि ग्रुप", "apf": "ए पी एफ", "bams": "बी ए एम एस", "bhms": "बी एच एम एस", "btech": "बी टेक",
    "baidyanath": "बैद्यनाथ", "big mart": "बिग मार्ट", "bouddhanath": "बौद्धनाथ", "braindigit": "ब्रेनडिजिट", "broadlink": "ब्रोडलिङ्क", "bungamati": "बुङ्गमती",
    "cfo": "सी एफ ओ", "cft": "सी एफ टी", "cg group": "सी जी ग्रुप", "cg net": "सी जी नेट", "century bank": "सेन्चुरी बैङ्क", "chapagaon": "चापागाउँ",
    "classic tech": "क्लासिक टेक", "cloudfactory": "क्लाउड फ्याक्ट्री", "cotiviti": "कोटिभिटी", "dudbc": "डी यू डी बी सी", "dwidp": "डी डब्लु आई डी पी", "deerwalk": "डियरवाक",
    "dish home": "डिस होम", "f1soft": "एफ वान सफ्ट", "foodmandu": "फुडमान्डु", "g20": "जी बीस", "genese": "जेनेसे", "goldstar": "गोल्डस्टार",
    "hdmi": "एच डी एम आई", "hamro bazar": "हाम्रो बजार", "hamro patro": "हाम्रो पात्रो", "hisense": "हाइसेन्स", "horlicks": "हर्लिक्स", "iaea": "आई ए ई ए",
    "json": "जेसन", "jyoti group": "ज्योति ग्रुप", "khokana": "खोकना", "kwiks": "क्विक्स", "leapfrog": "लिपफ्रग", "mclr": "एम सी एल आर",
    "msc": "एम एस सी", "mtech": "एम टेक", "machhapuchchhre bank": "मच्छापुच्छ्रे बैङ्क", "mayos": "मायोस", "mero lagani": "मेरो लगानी", "moco": "मोको",
    "moit": "एम ओ आई टी", "nimh": "एन आई एम एच", "nescafe": "नेस्काफे", "nimbus group": "निम्बस ग्रुप", "okcredit": "ओके क्रेडिट", "phcc": "पी एच सी सी",
    "php": "पी एच पी", "pathao": "पठाओ", "quixote": "क्विक्जोट", "roi": "आर ओ आई", "rtgs": "आर टी जी एस", "sdo": "एस डी ओ",
    "swift": "स्विफ्ट", "salesberry": "सेल्सबेरी", "sano paila": "सानो पाइला", "sastodeal": "सस्तोडिल", "shangrila group": "शाङ्ग्रिला ग्रुप", "smart cell": "स्मार्ट सेल",
    "smartdoko": "स्मार्टडोको", "subisu": "सुबिसु", "surf excel": "सर्फ एक्सेल", "surya group": "सूर्य ग्रुप", "tcl": "टी सी एल", "tootle": "टुटल",
    "verisk": "भेरिस्क", "wipo": "विपो", "wai wai": "वाइ वाइ", "worldlink": "वर्ल्डलिङ्क", "yatriapp": "यात्री एप", "younginnovations": "यङ इनोभेसन्स",
    "zandu": "जन्डु", "indrive": "इनड्राइभ", "esewa": "इसेवा", "khalti": "खल्ती", "ncell": "एनसेल", "ntc": "एन टी सी", "nea": "एन ई ए",
    "covid": "कोभिड", "email": "इमेल", "internet": "इन्टरनेट", "online": "अनलाइन", "mobile": "मोबाइल", "computer": "कम्प्युटर", "facebook": "फेसबुक",
    "youtube": "युट्युब", "google": "गुगल", "whatsapp": "ह्वाट्सएप", "app": "एप", "bank": "बैङ्क", "office": "अफिस", "police": "पुलिस",
}
SYMBOL_WORDS = {"%": "प्रतिशत", "₹": "रुपैयाँ", "$": "डलर", "&": "एन्ड", "@": "एट", "+": "प्लस"}
CLUSTERS = {
    "chh": "छ", "cch": "च्छ", "sch": "स्क", "tch": "च", "ch": "च", "sh": "श", "th": "थ", "ph": "फ",
    "kh": "ख", "gh": "घ", "dh": "ध", "bh": "भ", "jh": "झ", "zh": "झ", "ck": "क", "ng": "ङ्ग",
    "qu": "क्व", "wh": "व",
}
CONSONANTS = {
    "b": "ब", "c": "क", "d": "ड", "f": "फ", "g": "ग", "h": "ह", "j": "ज", "k": "क",
    "l": "ल", "m": "म", "n": "न", "p": "प", "q": "क", "r": "र", "s": "स", "t": "ट",
    "v": "भ", "w": "व", "x": "क्स", "y": "य", "z": "ज",
}
# A vowel after a consonant is a sign, elsewhere a letter.
VOWEL_SIGNS = {"aa": "ा", "ee": "ी", "oo": "ु", "ai": "ै", "au": "ौ", "ou": "ौ", "ea": "ी", "a": "", "i": "ि", "u": "ु", "e": "े", "o": "ो"}
VOWEL_LETTERS = {"aa": "आ", "ee": "ई", "oo": "उ", "ai": "ऐ", "au": "औ", "ou": "औ", "ea": "ी", "a": "अ", "i": "इ", "u": "उ", "e": "ए", "o": "ओ"}
HALANT = "्"
BLANKS = "()[]-—–/"
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "॥": "।", ";": ",", "\u200d": ""}
SAFE = set("ँंःअआइईउऊऋएऐऑओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरऱलळवशषसह़ऽािीुूृॆेैॉोौ्क़ख़ग़ज़ड़ढ़फ़य़ॠ।०१२३!\"',.:? \t\n…‌")
