"""Small tables written out: fixed values that the goldens were worked out by hand for."""

RECORDS_SQL = """SELECT * FROM (VALUES
('pcg-214-1@2026-01-01', '214-1', 'Livre I > Titre II', 'Les amortissements des immobilisations sont répartis sur leur durée probable d''utilisation.', 'regulatory'),
('pcg-214-1-c1@2026-01-01', '214-1', 'Livre I > Titre II', 'Commentaire sur les amortissements dérogatoires et leur comptabilisation.', 'comment'),
('pcg-214-10@2026-01-01', '214-10', 'Livre I > Titre II', 'Les dépréciations sont constatées lorsque la valeur actuelle devient inférieure.', 'regulatory'),
('pcg-321-5@2026-01-01', '321-5', 'Livre II > Titre III', 'Le contrat de crédit-bail figure dans l''annexe de l''entité qui le prend.', 'regulatory'),
('pcg-321-5@2024-01-01', '321-5', 'Livre II > Titre III', 'Le contrat de crédit-bail figurait dans l''annexe de cette entité autrefois.', 'regulatory'),
('pcg-410-2@2026-01-01', '410-2', 'Livre III > Titre 5', 'Les subventions d''investissement sont inscrites au passif puis reprises au résultat.', 'regulatory'),
('pcg-na-1@2026-01-01', NULL, 'Livre III', 'Texte sans article rattaché à la section courante du recueil.', 'comment'),
('pcg-na-2@2026-01-01', NULL, 'Livre III', '', 'comment'),
('pcg-410-2@2026-01-01', '410-2', 'Livre III > Titre 5', 'Fragment en double d''un article déjà ouvert plus haut.', 'regulatory')
) AS r(record_id, article, path, text, type)"""

EDGES_SQL = """SELECT * FROM (VALUES
(1, 'pcg-214-1@2026-01-01', 'pcg-214-10', 'internal'), (2, 'pcg-214-1@2026-01-01', 'pcg-999-1', 'internal'), (3, 'pcg-214-1@2026-01-01', 'crc-04-01', 'historical'),
(4, 'pcg-214-10@2026-01-01', 'pcg-410-2', 'internal'), (5, 'pcg-321-5@2026-01-01', 'pcg-214-1', 'internal'), (6, 'pcg-410-2@2026-01-01', 'legi-1844-5-code-civil', 'external')
) AS e(edge_no, source_id, target, family)"""

ROUTE_SQL = """SELECT * FROM (VALUES
(1, 'Que dit l''article 214-1 ?'), (2, 'Comparer Art. 321-5 et art. 214-10 du plan'), (3, 'Quels amortissements ?'), (4, 'Les articles 410-2 et 214-1, puis article 410-2')
) AS q(item_id, text)"""

CITED_SQL = """SELECT * FROM (VALUES
(1, 1, 'pcg-214-1@2026-01-01', 'Les   amortissements des immobilisations sont répartis'), (2, 1, 'pcg-214-1@2026-01-01', 'amortir'),
(3, 1, 'pcg-321-5', 'Le contrat de crédit-bail figure dans l''annexe'), (4, 2, 'pcg-214-10', 'Les dépréciations sont constatées lorsque la valeur'),
(5, 2, 'pcg-214-10@2026-01-01', 'Un extrait qui ne figure nulle part dans ce texte'), (6, 3, 'pcg-777-7@2026-01-01', 'Un extrait d''un enregistrement qui n''existe pas'),
(7, 4, 'pcg-214-10@2026-01-01', 'Les dépréciations sont constatées lorsque la valeur actuelle'), (8, 4, 'pcg-321-5@2024-01-01', 'LE CONTRAT DE CRÉDIT-BAIL FIGURAIT DANS L’ANNEXE')
) AS c(cite_id, item_id, record_id, extract)"""

LINES_SQL = """SELECT * FROM (VALUES
(1, 1, 'Livre I Principes', 12.0, true, 'Tahoma', 70.0, 100.0, 20), (1, 2, 'Titre II Actif', 11.0, true, 'Tahoma', 70.0, 120.0, 20), (1, 3, 'et évaluation', 11.0, true, 'Tahoma', 70.0, 140.0, 20),
(1, 4, 'Art. 214-1 Les biens', 10.0, true, 'Tahoma', 70.0, 160.0, 20), (1, 5, 'sont amortis selon les articles 214-2 et 214-', 10.0, false, 'Tahoma', 70.0, 180.0, 20), (1, 6, '3.', 10.0, false, 'Tahoma', 70.0, 200.0, 20),
(1, 7, '20', 10.0, false, 'Tahoma', 40.0, 500.0, 20), (1, 8, 'IR 3 – Commentaire', 9.5, true, 'Tahoma', 70.0, 220.0, 21), (1, 9, 'Le texte du commentaire.', 9.5, false, 'Tahoma', 70.0, 240.0, 21),
(1, 10, '-', 9.5, false, 'Symbol', 70.0, 260.0, 21), (1, 11, 'premier point', 9.5, false, 'Tahoma', 80.0, 260.0, 21), (1, 12, 'Article 214-2 Suite', 10.0, true, 'Tahoma', 70.0, 280.0, 21),
(1, 13, 'Un alinéa.', 10.0, false, 'Tahoma', 70.0, 300.0, 22), (1, 14, 'Chapitre I Autres ........ 45', 11.0, true, 'Tahoma', 70.0, 320.0, 22), (1, 15, 'Chapitre II Passif', 11.0, true, 'Tahoma', 70.0, 340.0, 22),
(1, 16, 'Texte de section.', 10.0, false, 'Tahoma', 70.0, 360.0, 22), (1, 17, 'entre deux', 9.2, false, 'Tahoma', 70.0, 380.0, 22), (1, 18, 'Art. 214-2 bis', 10.0, true, 'Tahoma', 70.0, 400.0, 23), (1, 19, 'Encore un alinéa.', 10.0, false, 'Tahoma', 70.0, 420.0, 23),
(2, 1, 'Titre I Bilan', 10.6, false, 'Tahoma', 70.0, 80.0, 30), (2, 2, 'pied de page', 8.0, false, 'Tahoma', 70.0, 800.0, 30), (2, 3, 'Annexe', 12.0, true, 'Tahoma', 70.0, 90.0, 30), (2, 4, 'Texte libre.', 10.0, false, 'Tahoma', 70.0, 110.0, 31)
) AS l(doc_id, seq, text, size, bold, font, x, y, page)"""

REWRITES_SQL = """SELECT * FROM (VALUES
(1, 'Que dit l''article 214-1 ?', 'amortissement article 214-1', '214-1'), (2, 'Quels amortissements ?', 'amortissement 214-1 214-10', '214-1'), (3, 'Quelles subventions ?', 'subventions 999-1', '410-2'), (4, 'Crédit-bail ?', 'crédit-bail annexe', '321-5')
) AS w(item_id, question, rewrite, gold)"""

ANSWERS_SQL = """SELECT * FROM (VALUES
(1, true, 'out_of_scope'), (2, true, 'fiscal'), (3, false, 'fiscal'), (4, true, 'not_in_corpus'), (5, false, 'not_in_corpus'), (6, true, 'fiscal')
) AS a(item_id, abstention, reason)"""


CITING_SQL = """SELECT * FROM (VALUES
('c1', 'Voir les articles 212-1 et 212-2, puis l''article 1844-5 du code civil.'), ('c2', 'article L. 521-1 du Code monétaire et financier et article L. 521-2 du même code.'), ('c3', 'Avis CNC n° 2004-15 et règlement CRC n° 04-01')
) AS t(id, text)"""
