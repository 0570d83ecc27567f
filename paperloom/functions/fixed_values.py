"""Fixed values that mapping results depend on: word lists and tables, in their order of precedence."""

#: Form label -> profile key, in five languages. A label is looked up as it is; then the first entry
#: that contains the label or is contained in it decides.
INSTANT_LABELS = {
    "first name": "first_name", "given name": "first_name", "forename": "first_name",
    "last name": "last_name", "surname": "last_name", "family name": "last_name",
    "full name": "full_name", "name": "full_name",
    "middle name": "middle_name", "middle initial": "middle_name",
    "date of birth": "date_of_birth", "dob": "date_of_birth", "birth date": "date_of_birth", "birthday": "date_of_birth",
    "gender": "gender", "sex": "gender",
    "nationality": "nationality", "citizenship": "nationality",
    "marital status": "marital_status",
    "phone": "phone", "phone number": "phone", "telephone": "phone", "mobile": "phone", "cell": "phone", "mobile phone": "phone",
    "email": "email", "email address": "email", "e-mail": "email",
    "address": "address", "street": "address", "street address": "address", "address line 1": "address",
    "apartment": "address_line_2", "apt": "address_line_2", "suite": "address_line_2", "unit": "address_line_2",
    "city": "city", "town": "city",
    "state": "state", "province": "state", "region": "state",
    "zip": "zip_code", "zip code": "zip_code", "postal code": "zip_code", "postcode": "zip_code",
    "country": "country", "nation": "country",
    "passport number": "passport_number", "passport no": "passport_number", "passport #": "passport_number",
    "passport expiry": "passport_expiry", "passport expiration": "passport_expiry",
    "national id": "national_id", "id number": "national_id", "identity number": "national_id",
    "driver license": "drivers_license", "drivers license": "drivers_license", "driving license": "drivers_license",
    "ssn": "ssn", "social security": "ssn", "social security number": "ssn", "tax id": "ssn", "tin": "ssn",
    "employer": "employer_name", "company": "employer_name", "company name": "employer_name", "organization": "employer_name",
    "job title": "job_title", "position": "job_title", "occupation": "job_title", "title": "job_title", "role": "job_title",
    "salary": "annual_salary", "income": "annual_salary", "annual income": "annual_salary", "annual salary": "annual_salary",
    "bank": "bank_name", "bank name": "bank_name",
    "account number": "account_number", "account no": "account_number",
    "iban": "iban", "routing number": "routing_number",
    "insurance": "insurance_provider", "insurer": "insurance_provider",
    "policy number": "insurance_number",
    "emergency contact": "emergency_contact_name",
    "education": "education_level", "highest education": "education_level",
    "university": "university", "school": "university", "college": "university",
    "degree": "degree",
    "graduation year": "graduation_year", "year of graduation": "graduation_year",
    "vorname": "first_name", "nachname": "last_name", "familienname": "last_name",
    "geburtsdatum": "date_of_birth", "geburtstag": "date_of_birth",
    "geschlecht": "gender", "staatsangehörigkeit": "nationality",
    "familienstand": "marital_status", "telefon": "phone", "telefonnummer": "phone",
    "straße": "address", "anschrift": "address", "adresse": "address",
    "stadt": "city", "ort": "city", "plz": "zip_code", "postleitzahl": "zip_code",
    "land": "country", "beruf": "job_title", "arbeitgeber": "employer_name",
    "reisepassnummer": "passport_number", "personalausweis": "national_id",
    "prénom": "first_name", "nom": "last_name", "nom de famille": "last_name",
    "date de naissance": "date_of_birth", "sexe": "gender",
    "nationalité": "nationality", "état civil": "marital_status",
    "téléphone": "phone", "rue": "address",
    "ville": "city", "code postal": "zip_code", "pays": "country",
    "profession": "job_title", "employeur": "employer_name",
    "numéro de passeport": "passport_number",
    "nombre": "first_name", "apellido": "last_name", "apellidos": "last_name",
    "fecha de nacimiento": "date_of_birth", "sexo": "gender",
    "nacionalidad": "nationality", "estado civil": "marital_status",
    "teléfono": "phone", "dirección": "address", "calle": "address",
    "ciudad": "city", "código postal": "zip_code", "país": "country",
    "profesión": "job_title", "empresa": "employer_name",
    "número de pasaporte": "passport_number",
    "الاسم الأول": "first_name", "اسم العائلة": "last_name", "الاسم الكامل": "full_name",
    "تاريخ الميلاد": "date_of_birth", "الجنس": "gender",
    "الجنسية": "nationality", "الحالة الاجتماعية": "marital_status",
    "رقم الهاتف": "phone", "العنوان": "address",
    "المدينة": "city", "الرمز البريدي": "zip_code", "الدولة": "country",
    "المهنة": "job_title", "جهة العمل": "employer_name",
    "رقم جواز السفر": "passport_number",
}

#: Batch fill: label -> profile key, used if the profile has that key.
BATCH_LABELS = {
    "name": "full_name", "vorname": "first_name", "nachname": "last_name", "email": "email", "e-mail": "email",
    "telefon": "phone", "phone": "phone", "adresse": "address", "address": "address", "stadt": "city", "city": "city",
    "plz": "zip_code", "zip": "zip_code", "land": "country", "country": "country",
    "geburtsdatum": "date_of_birth", "date of birth": "date_of_birth",
}

#: Fallback fill: the first keyword contained in a field's name decides.
FALLBACK_KEYWORDS = {
    "first": "first_name", "given": "first_name", "last": "last_name", "surname": "last_name", "family": "last_name",
    "phone": "phone", "mobile": "phone", "tel": "phone", "email": "email", "mail": "email", "address": "address",
    "street": "address", "city": "city", "state": "state", "zip": "zip_code", "postal": "zip_code", "country": "country",
    "birth": "date_of_birth", "dob": "date_of_birth",
}

#: Ontology: key, kind and keywords; the first keyword contained in a folded label decides, specific entries first.
ONTOLOGY = [
    ("date_of_birth", "date", ["date of birth", "geburtsdatum", "geburtstag", "geboren am", "birth date", "birthday", "fecha de nacimiento", "dob"]),
    ("place_of_birth", "place", ["place of birth", "geburtsort", "birthplace", "geburtsland"]),
    ("first_name", "name", ["first name", "given name", "forename", "vorname", "prenom", "prénom", "nombre"]),
    ("last_name", "name", ["last name", "surname", "family name", "nachname", "familienname", "nom de famille", "apellidos", "apellido"]),
    ("birth_name", "name", ["geburtsname", "birth name", "maiden name", "mädchenname", "madchenname"]),
    ("spouse_name", "name", ["name des ehegatten", "ehegatte", "ehepartner", "ehefrau", "ehemann", "spouse"]),
    ("full_name", "name", ["full name", "vollständiger name", "vollstandiger name", "vor- und nachname", "name and surname", "name"]),
    ("nationality", "text", ["nationality", "citizenship", "staatsangehörigkeit", "staatsangehorigkeit", "nationalität", "nationalitat", "nacionalidad"]),
    ("gender", "gender", ["gender", "sex", "geschlecht"]),
    ("marital_status", "text", ["marital status", "familienstand", "civil status", "estado civil"]),
    ("email", "email", ["e-mail", "email", "e mail", "correo"]),
    ("phone_number", "phone", ["telephone", "phone", "telefon", "téléphone", "telefono", "teléfono", "mobile", "mobil", "handy"]),
    ("fax", "phone", ["telefax", "faxnummer", "fax"]),
    ("postal_code", "postalCode", ["postal code", "post code", "postcode", "postleitzahl", "plz", "zip", "código postal", "codigo postal"]),
    ("house_number", "number", ["hausnummer", "house number", "haus-nr", "hausnr", "house no"]),
    ("street_address", "street", ["street address", "street", "straße", "strasse", "anschrift", "adresse", "address", "dirección", "direccion"]),
    ("city", "city", ["city", "town", "wohnort", "ort", "stadt", "ciudad"]),
    ("country", "country", ["country", "staat", "land", "pays", "país", "pais"]),
    ("tax_id", "number", ["steueridentifikationsnummer", "steuer-id", "steuer id", "steuerid", "tax identification", "tax id", "steuernummer", "tax number"]),
    ("social_security", "number", ["sozialversicherungsnummer", "social security", "sv-nummer", "versicherungsnummer", "insurance number"]),
    ("passport_number", "idNumber", ["passport", "reisepass", "passnummer"]),
    ("id_number", "idNumber", ["id number", "identity card", "personalausweis", "ausweisnummer", "ausweis", "identity", "id no"]),
    ("iban", "iban", ["iban"]),
    ("bank_account", "number", ["kontonummer", "konto-nr", "kontonr", "account number"]),
    ("bic", "text", ["bic", "swift"]),
    ("health_insurance", "text", ["krankenkasse", "krankenversicherung", "health insurance", "gesundheitskasse"]),
    ("bank_name", "text", ["bank", "kreditinstitut"]),
    ("employer_name", "text", ["employer", "arbeitgeber", "company", "firma", "unternehmen", "empresa"]),
    ("job_title", "text", ["job title", "occupation", "beruf", "position", "tätigkeit", "tatigkeit", "profession", "profesión", "profesion"]),
    ("religion", "text", ["religion", "konfession", "glaubensbekenntnis", "religionszugehörigkeit", "religionszugehorigkeit"]),
    ("children_count", "number", ["kinder", "children", "anzahl kinder", "number of children", "kinderzahl"]),
    ("tax_class", "number", ["steuerklasse", "tax class", "lohnsteuerklasse"]),
    ("federal_state", "text", ["bundesland", "federal state", "state", "province"]),
    ("move_in_date", "date", ["einzugsdatum", "einzug", "move-in date", "date of move", "umzugsdatum"]),
    ("landlord", "text", ["vermieter", "landlord", "hausverwaltung"]),
    ("rent_amount", "number", ["miete", "rent", "kaltmiete", "warmmiete", "monatsmiete"]),
    ("living_space", "number", ["wohnfläche", "wohnflache", "living space", "wohnungsgröße", "wohnungsgrosse", "quadratmeter", "qm"]),
    ("signature", "signature", ["signature", "unterschrift", "sign here", "signed"]),
    ("date_today", "date", ["date", "datum", "fecha"]),
]

#: Words that mark a signature field.
SIGNATURE_LABELS = [
    "signature", "sign here", "signed", "authorized signature", "witness", "notary",
    "unterschrift", "unterschriften", "ort, datum, unterschrift", "datum, unterschrift", "hier unterschreiben", "unterzeichner",
    "signer ici", "signataire", "التوقيع", "توقيع", "واژۆ", "ئیمزا",
]

#: Field types by the first group that has a keyword in the lower-cased label; glyphs and short options are tested between.
TYPE_KEYWORDS = {
    "signature": ["signature", "unterschrift", "sign here", "signed"],
    "option": ["ja", "nein", "yes", "no", "männlich", "weiblich", "divers", "ledig", "verheiratet"],
    "email": ["e-mail", "email", "e mail"],
    "date": ["date", "datum", "birth", "geburt", "geboren", "dob", "valid", "expiry"],
    "phone": ["phone", "tel", "telefon", "mobile", "handy", "fax"],
    "number": ["amount", "betrag", "iban", "zip", "postal", "plz", "number", "nummer", "no.", "nr", "sum", "total", "konto", "account", "salary", "income", "einkommen"],
    "name": ["name", "vorname", "nachname", "first name", "last name", "surname", "familienname"],
}
CHECKBOX_GLYPHS = "[]()□☐☑☒■◻◼⬜"
RADIO_GLYPHS = "○◎◉◯⚪⚫"

#: Words that tell what a form field takes.
INPUT_KEYWORDS = {
    "email": ["e-mail", "email", "mail", "ئیمەیڵ", "البريد", "ایمیل", "correo"],
    "place": ["place", "city", "town", "stadt", "wohnort", "geburtsort", "شوێن", "مكان", "محل", "lugar", "ciudad"],
    "date": ["datum", "date", "geburtsdatum", "geboren", "birth", "tt.mm", "dd.mm", "dd/mm", "mm/dd", "jjjj", "yyyy", "بەروار", "تاريخ", "تاریخ", "fecha"],
    "phone": ["telefon", "phone", "tel.", "mobil", "handy", "fax", "تەلەفۆن", "مۆبایل", "هاتف", "تلفن", "teléfono"],
    "zip": ["plz", "postleitzahl", "zip", "postal", "postcode", "código postal"],
    "number": ["hausnummer", "hausnr", "betrag", "amount", "anzahl", "summe", "menge", "quantity", "ژمارە", "رقم", "عدد"],
}

#: Profile keys by the first rule that has a keyword in the lower-cased label.
PROFILE_RULES = {
    "first_name": ["first name", "given name", "forename", "vorname", "prénom", "prenom", "nombre", "الاسم الأول"],
    "last_name": ["last name", "surname", "family name", "nachname", "familienname", "nom de famille", "apellido", "apellidos", "اسم العائلة"],
    "date_of_birth": ["date of birth", "birth date", "birthday", "dob", "geburtsdatum", "geburtstag", "date de naissance", "fecha de nacimiento", "تاريخ الميلاد"],
    "nationality": ["nationality", "citizenship", "staatsangehörigkeit", "nationalité", "nacionalidad", "الجنسية"],
    "email": ["email", "e-mail", "correo", "البريد"],
    "phone_number": ["phone", "telephone", "mobile", "telefon", "téléphone", "telefono", "teléfono", "الهاتف"],
    "postal_code": ["postal code", "post code", "postcode", "zip", "plz", "postleitzahl", "code postal", "código postal", "codigo postal", "الرمز البريدي"],
    "street_address": ["address", "street", "anschrift", "straße", "strasse", "adresse", "dirección", "direccion", "calle", "العنوان"],
    "city": ["city", "town", "stadt", "ville", "ciudad", "المدينة"],
    "country": ["country", "pays", "país", "pais", "الدولة"],
    "id_number": ["passport", "id number", "identity", "national id", "reisepass", "ausweis", "pasaporte", "جواز"],
    "employer_name": ["employer", "company", "organization", "organisation", "arbeitgeber", "employeur", "empresa", "جهة العمل"],
    "job_title": ["job title", "occupation", "position", "beruf", "profession", "profesión", "profesion", "cargo", "المهنة"],
}

#: Files that may be analysed.
ALLOWED_TYPES = (
    "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword",
    "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/webp", "image/gif",
)
UPLOAD_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/png", "image/jpeg")
WIDGET_KINDS = {1: "text", 2: "checkbox", 3: "radio", 4: "select", 5: "text", 6: "signature"}
