"""Sentences written after the lists of the operator, to tell how far it goes beyond them: text and (type, item) pairs."""

FRESH = [
    ("Please send it to Thaddeus Okonkwo tomorrow.", [("NAME", "Thaddeus Okonkwo")]),
    ("My name is Bronwyn Gallagher and I moved.", [("NAME", "Bronwyn Gallagher")]),
    ("Regards, Oluwaseun Adeyemi", [("NAME", "Oluwaseun Adeyemi")]),
    ("This is Ingrid Halvorsen from the third floor.", [("NAME", "Ingrid Halvorsen")]),
    ("I spoke with Dmitri Volkov about the fee.", [("NAME", "Dmitri Volkov")]),
    ("Mrs. Kowalczyk called about her card.", [("NAME", "Kowalczyk")]),
    ("Ich heiße Jürgen Brandt und brauche Hilfe.", [("NAME", "Jürgen Brandt")]),
    ("Je m'appelle Solène Marchand.", [("NAME", "Solène Marchand")]),
    ("Dear Mr. Nakamura, your request is closed.", [("NAME", "Nakamura")]),
    ("The nominee is Esperanza Villalobos.", [("NAME", "Esperanza Villalobos")]),
    ("Our tenant Wolfgang Steiner pays by transfer.", [("NAME", "Wolfgang Steiner")]),
    ("Could Priscilla sign for me?", [("NAME", "Priscilla")]),
    ("I live at Hauptstraße 12, 10115 Berlin and work there.", [("ADDRESS", "Hauptstraße 12, 10115 Berlin")]),
    ("Send it to 12 rue de la Paix, Paris.", [("ADDRESS", "12 rue de la Paix, Paris")]),
    ("Mi casa: Calle Mayor 14, Madrid.", [("ADDRESS", "Calle Mayor 14, Madrid")]),
    ("The parcel goes to Lindenallee 7b, 50968 Köln.", [("ADDRESS", "Lindenallee 7b, 50968 Köln")]),
    ("Abito in via Garibaldi 23, Torino.", [("ADDRESS", "via Garibaldi 23, Torino")]),
    ("Moro na Rua Augusta 1500, Lisboa.", [("ADDRESS", "Rua Augusta 1500, Lisboa")]),
    ("Our office is at 221B Baker Street, London.", [("ADDRESS", "221B Baker Street, London")]),
    ("Ship to 1600 Pennsylvania Avenue, Washington please.", [("ADDRESS", "1600 Pennsylvania Avenue, Washington")]),
    ("J'habite 8 bis avenue des Ternes, Paris.", [("ADDRESS", "8 bis avenue des Ternes, Paris")]),
    ("Collect at Flat 4, 19 Mill Lane, Bath.", [("ADDRESS", "Flat 4, 19 Mill Lane, Bath")]),
    ("Call me on 020 7946 0958.", [("PHONE", "020 7946 0958")]),
    ("My mobile is +49 151 23456789.", [("PHONE", "+49 151 23456789")]),
    ("Ring (415) 555-2671 after six.", [("PHONE", "(415) 555-2671")]),
    ("Mon numéro est le 01 42 68 53 00.", [("PHONE", "01 42 68 53 00")]),
    ("Reach me at 415-555-2671 today.", [("PHONE", "415-555-2671")]),
    ("WhatsApp: +55 11 91234-5678", [("PHONE", "+55 11 91234-5678")]),
    ("My number is 98200 11223.", [("PHONE", "98200 11223")]),
    ("Try tel:+442079460958 first.", [("PHONE", "+442079460958")]),
    ("Write to o.adeyemi@mail.example.ng now.", [("EMAIL", "o.adeyemi@mail.example.ng")]),
    ("It is ingrid (at) fjord (dot) example", [("EMAIL", "ingrid (at) fjord (dot) example")]),
    ("mailto:jb@werk.example works", [("EMAIL", "jb@werk.example")]),
    ("My PAN is QWERT1234Z.", [("ID", "QWERT1234Z")]),
    ("My SSN is 078-05-1120.", [("ID", "078-05-1120")]),
    ("Aadhaar 4821 7733 9012 is linked.", [("ID", "4821 7733 9012")]),
    ("Passport K8273645 expires soon.", [("ID", "K8273645")]),
    ("Transfer 482177339012 reached account 59302847561.", []),
    ("Ticket 7946095812 was closed on 12 March 2024.", []),
    ("The Harrow Plaza branch in place of the old one opens at 9:30.", []),
    ("Call 1800 425 3800 for the toll-free line.", []),
    ("Via UPI 24 payments were made to Kestrel Valley Bank.", []),
]

#: Written after the last change of the operator and never used to change it.
UNSEEN = [
    ("My colleague Anneliese Hofmann will collect it.", [("NAME", "Anneliese Hofmann")]),
    ("Ask Mr. Tembo about the form.", [("NAME", "Tembo")]),
    ("Signed, Rosalind Achterberg", [("NAME", "Rosalind Achterberg")]),
    ("The account belongs to Mireille Lafontaine.", [("NAME", "Mireille Lafontaine")]),
    ("Yesterday Bartholomew Finch opened the vault.", [("NAME", "Bartholomew Finch")]),
    ("Hello, I am Zeynep Aydın.", [("NAME", "Zeynep Aydın")]),
    ("Contact person: Hiroshi Tanaka", [("NAME", "Hiroshi Tanaka")]),
    ("Thanks, Guadalupe", [("NAME", "Guadalupe")]),
    ("We moved to Goethestr. 5, 60313 Frankfurt.", [("ADDRESS", "Goethestr. 5, 60313 Frankfurt")]),
    ("Deliver to 45 boulevard Saint-Michel, Paris.", [("ADDRESS", "45 boulevard Saint-Michel, Paris")]),
    ("Vivo en Avenida de América 33, Madrid.", [("ADDRESS", "Avenida de América 33, Madrid")]),
    ("Post it to 7 Orchard Close, Leeds.", [("ADDRESS", "7 Orchard Close, Leeds")]),
    ("My flat: 350 Fifth Avenue, New York.", [("ADDRESS", "350 Fifth Avenue, New York")]),
    ("Wir wohnen Am Markt 3, 28195 Bremen.", [("ADDRESS", "Am Markt 3, 28195 Bremen")]),
    ("Phone 0161 496 0345 in the evening.", [("PHONE", "0161 496 0345")]),
    ("Tel. 030 901820 is the office.", [("PHONE", "030 901820")]),
    ("You can text +81 90-1234-5678.", [("PHONE", "+81 90-1234-5678")]),
    ("Fax: (212) 555-0187", [("PHONE", "(212) 555-0187")]),
    ("Mein Handy: 0171 2345678", [("PHONE", "0171 2345678")]),
    ("Send a copy to mireille.l@poste.example, please.", [("EMAIL", "mireille.l@poste.example")]),
    ("My Emirates ID is 784-1988-1234567-1.", [("ID", "784-1988-1234567-1")]),
    ("PAN: ZXCVB9876Q", [("ID", "ZXCVB9876Q")]),
    ("Branch code 0161 was merged with unit 345.", []),
    ("Rates rose from Prime Plus to Gold Standard in May.", []),
    ("Invoice 2024-5550-1873 is paid.", []),
]
