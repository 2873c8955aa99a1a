"""Pages written by hand in layouts and languages that no template makes: (html, main text)."""

P1 = "The harbour was quiet when the first boats came in, and nobody had expected so many fish this early."
P2 = "By noon the market had sold out. People stood in line for hours, though rain kept falling on the stalls."
P3 = "Officials said that the season may last until June, but older fishermen are not so sure about it."
F1 = "Le conseil municipal a voté hier soir le budget de la ville, après un long débat sur les écoles."
F2 = "Les travaux commenceront au printemps prochain. La mairie promet de tenir les délais, malgré la pluie."
D1 = "Die Brücke über den Fluss wird im Sommer gesperrt, weil die Pfeiler erneuert werden müssen."
D2 = "Bis dahin fahren alle Busse wie gewohnt. Anwohner klagen über Lärm, den die Baustelle verursacht."
S1 = "El museo abrió sus puertas después de tres años de obras, y cientos de vecinos visitaron las salas."
S2 = "La entrada será gratuita hasta fin de mes. El director espera que vuelvan también los turistas."
I1 = "La vendemmia comincia presto quest'anno, perché l'estate è stata calda e asciutta in tutta la valle."
I2 = "I produttori parlano di un raccolto scarso, ma di ottima qualità. I prezzi saliranno, dicono tutti."


def _p(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


PAGES = [
    # A blog of divs with names in German, comments with name and date.
    (f"<html lang=de><body><div class=kopf><a href=/>Start</a> <a href=/a>Archiv</a> <a href=/k>Kontakt</a></div><div class=inhalt><h1>Brücke gesperrt</h1>{_p(D1, D2)}</div><div class=kommentare><h3>2 Kommentare</h3><div class=beitrag><div>Anna 3.5.2021</div><p>Das wurde auch Zeit, finde ich.</p></div><div class=beitrag><div>Ben 4.5.2021</div><p>Und wer bezahlt das alles am Ende?</p></div></div><div class=fuss>&copy; 2021</div></body></html>", f"Brücke gesperrt\n{D1}\n{D2}"),
    # The same without any names.
    (f"<body><div><a href=/>Start</a> <a href=/a>Archiv</a></div><div><h1>Brücke gesperrt</h1>{_p(D1, D2)}</div><div><h3>2 Kommentare</h3><div><div>Anna 3.5.2021</div><p>Das wurde auch Zeit, finde ich.</p></div><div><div>Ben 4.5.2021</div><p>Und wer bezahlt das alles?</p></div></div></body>", f"Brücke gesperrt\n{D1}\n{D2}"),
    # Utility classes only.
    (f"<body><nav class='flex p-4 bg-white'><a href=/>Home</a><a href=/x>About</a></nav><main class='mt-8 px-4'><h1 class='text-xl'>Early fish</h1>{_p(P1, P2, P3)}</main><footer class='p-4 text-sm'>All rights reserved</footer></body>", f"Early fish\n{P1}\n{P2}\n{P3}"),
    # Table layout of the nineties.
    (f"<body bgcolor=white><table><tr><td><a href=a>News</a><br><a href=b>Links</a><br><a href=c>Guestbook</a></td><td><h1>Early fish</h1>{_p(P1, P2)}</td></tr></table></body>", f"Early fish\n{P1}\n{P2}"),
    # An article with a figure, a quotation and a list.
    (f"<body><header><a href=/>Daily</a></header><article><h1>Le budget</h1><p>{F1}</p><blockquote>{F2}</blockquote><ul><li>Une école rénovée</li><li>Deux lignes de bus</li></ul><p>{F2}</p></article><aside><h3>Lire aussi</h3><ul><li><a href=1>Un pont</a></li><li><a href=2>Une place</a></li></ul></aside></body>", f"Le budget\n{F1}\n{F2}\nUne école rénovée\nDeux lignes de bus\n{F2}"),
    # A cookie wall before everything.
    (f"<body><div class=rgpd><p>Nous utilisons des cookies pour améliorer le site.</p><button>Accepter</button></div><article><h1>Le budget</h1>{_p(F1, F2)}</article></body>", f"Le budget\n{F1}\n{F2}"),
    # An unclosed script at the end, and one in the middle.
    (f"<body><article><h1>El museo</h1><p>{S1}</p><script>var a = '<p>no</p>';</script><p>{S2}</p></article><script>var leak = 'secret text of a script'", f"El museo\n{S1}\n{S2}"),
    # Paragraphs that nobody closes.
    (f"<body><ul><li><a href=1>Inicio</a><li><a href=2>Prensa</a></ul><article><h2>El museo</h2><p>{S1}<p>{S2}</article><footer>Contacto", f"El museo\n{S1}\n{S2}"),
    # Wrapped five deep.
    (f"<body><div><div><div><div><div class=testo><h1>La vendemmia</h1>{_p(I1, I2)}</div></div></div></div></div><div class=pie><a href=1>Privacy</a> <a href=2>Contatti</a></div></body>", f"La vendemmia\n{I1}\n{I2}"),
    # Advertisements between paragraphs.
    (f"<body><article><h1>Early fish</h1><p>{P1}</p><div class=ad><a href=/buy>Buy our boats now</a></div><p>{P2}</p><div class='ad-slot'><a href=/b>Sponsored: cheap nets</a></div><p>{P3}</p></article></body>", f"Early fish\n{P1}\n{P2}\n{P3}"),
    # A sidebar before the article.
    (f"<body><div id=page><aside class=sidebar><h3>Most read</h3><ul><li><a href=1>One story</a></li><li><a href=2>Another story</a></li><li><a href=3>A third</a></li></ul></aside><section><h1>Early fish</h1>{_p(P1, P2)}</section></div></body>", f"Early fish\n{P1}\n{P2}"),
    # A signup form inside the article.
    (f"<body><article><h1>El museo</h1><p>{S1}</p><form action=/s><p>Recibe las noticias en tu correo</p><input name=mail><button>Enviar</button></form><p>{S2}</p></article></body>", f"El museo\n{S1}\n{S2}"),
    # One paragraph only.
    (f"<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><p>{P1}</p></article><footer><p>&copy; someone</p></footer></body>", P1),
    # Links inside sentences.
    (f"<body><header><h2><a href=/>Gazzetta</a></h2></header><article><h1>La vendemmia</h1><p>{I1} Lo dice <a href=/x>uno studio</a> di ieri.</p><p>{I2}</p></article></body>", f"La vendemmia\n{I1} Lo dice uno studio di ieri.\n{I2}"),
    # A page that only lists links.
    ("<body><nav><a href=/>Home</a> <a href=/a>A</a></nav><div class=menu><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div><footer>&copy; nobody</footer></body>", ""),
    # Character references and white space.
    (f"<body><article>\n <h1>Fish &amp;\n chips</h1>\n\n<p>  {P1}  &eacute;t&eacute; </p></article></body>", f"Fish & chips\n{P1} été"),
    # Subheadings.
    (f"<body><main><h1>Early fish</h1><p>{P1}</p><h2>Prices</h2><p>{P2}</p><h2>Outlook</h2><p>{P3}</p></main><nav><a href=1>Next</a> <a href=2>Back</a></nav></body>", f"Early fish\n{P1}\nPrices\n{P2}\nOutlook\n{P3}"),
    # Share buttons around.
    (f"<body><div class=share><a href=f>Share</a> <a href=t>Tweet</a></div><article><h1>Le budget</h1>{_p(F1, F2)}</article><div class=share><a href=f>Share</a> <a href=t>Tweet</a></div></body>", f"Le budget\n{F1}\n{F2}"),
    # Replies in an ordered list, in an unknown language of names.
    (f"<body><div class=artikkeli><h1>Early fish</h1>{_p(P1, P2, P3)}</div><ol class=kommentit><li><div><b>Pekka</b> 12.3.2020</div><p>I saw that too, it was cold.</p></li><li><div><b>Liisa</b> 13.3.2020</div><p>Nice pictures, thank you all.</p></li></ol></body>", f"Early fish\n{P1}\n{P2}\n{P3}"),
    # A notice that is hidden.
    (f"<body><div style='display:none'><p>Please switch on scripts to read this page.</p></div><article><h1>El museo</h1>{_p(S1, S2)}</article></body>", f"El museo\n{S1}\n{S2}"),
]
