"""Given names that mark a person without a title, by gender. Names that are everyday words at the
head of a sentence (Will, May, Mark, Hope, Bill and the like) are left out."""

FEMALE = tuple(
    """Linda Lisa Nancy Betty Sandra Ashley Kimberly Donna Michelle Dorothy Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Shirley Anna Brenda Pamela Emma Nicole Helen Samantha
    Katherine Catherine Kathryn Christine Debra Rachel Carolyn Janet Maria Heather Diane Ruth Julie Olivia Joyce Virginia Victoria Lauren Christina Joan Evelyn Judith Megan Andrea Cheryl Hannah Jacqueline Martha Gloria Teresa
    Ann Anne Annie Sara Madison Kathy Janice Jean Alice Abigail Julia Judy Sophia Denise Amber Doris Marilyn Danielle Beverly Isabella Theresa Diana Natalie Brittany Kayla Alexis Lori Marie Tiffany Jane Julianne Ellen Eleanor
    Frances Josephine Caroline Lucy Louise Alison Fiona Gillian Hazel Heidi Irene Edith Esther Eva Paula Peggy Phyllis Roberta Sally Sheila Sonia Sophie Sylvia Tracy Vanessa Wendy Yvonne Zoe Chloe Amelia Mia Ella Emilia Clara Nora Vera
    Rosa Bridget Siobhan Aoife Niamh Maureen Molly Naomi Miriam Leah Lydia Tamara Tanya Tina Monica Veronica Valerie Bonnie Connie Audrey Harriet Agnes Cecilia Constance Priscilla Penelope Beatrice Beatrix Bertha Thelma Lorraine Rosemary Vivian
    Petra Andrea Birgit Brigitte Christa Elke Erika Gabriele Gisela Greta Gudrun Hannelore Heike Helga Ilse Inge Ingrid Jutta Karin Katharina Katja Katrin Kerstin Lena Lieselotte Manuela Marlene Martina Nadine Renate Silke Simone Susanne Svenja Tanja Ulrike Ute Waltraud Anja Antje Anke Annette Bettina Cornelia Dagmar Doreen Franziska Friederike Johanna Lea Leonie Luise Melanie Mareike Nina Steffi
    Chantal Martine Monique Nicole Sylvie Véronique Valérie Céline Hélène Élodie Élise Émilie Aurélie Amélie Anaïs Brigitte Catherine Christiane Colette Corinne Danielle Delphine Dominique Dorothée Florence Geneviève Jacqueline Jeanne Josiane Juliette Laetitia Laure Léa Lucie Madeleine Manon Margaux Marion Mathilde Michèle Mireille Noémie Odile Pauline Sandrine Séverine Simone Solange Sophie Stéphanie Suzanne Thérèse Virginie Yvette Inès Chloé Zoé
    Ana Isabel Pilar Laura Cristina Marta Josefa Lucia Antonia Elena Raquel Sara Paula Manuela Concepción Beatriz Alba Rocío Silvia Patricia Rosario Irene Nuria Inés Montserrat Andrea Alicia Sonia Sofía Encarnación Eva Ángela Mónica Verónica Adriana Alejandra Gabriela Guadalupe Juana Leticia Lourdes Luisa Magdalena Mercedes Natalia Soledad Susana Teresa Valentina Ximena Yolanda Catalina Camila Daniela Esperanza Fernanda Graciela
    Giulia Chiara Francesca Federica Alessandra Valentina Paola Giovanna Lucia Giuseppina Rosaria Caterina Antonella Elisa Ilaria Simona Stefania Roberta Daniela Bianca Donatella Fabiola Ornella Raffaella
    Agnieszka Ewa Katarzyna Małgorzata Joanna Magdalena Krystyna Zofia Barbara Danuta Jadwiga Dorota Beata Iwona Aleksandra Karolina Natalia Monika Olga Svetlana Tatiana Natasha Irina Yelena Ekaterina Anastasia Galina Ludmila Oksana Nadia Yulia Jana Lenka Zuzana Hana Eliška Ivana Milena Snežana Jelena Dragana Ildikó Katalin Zsuzsanna Erzsébet
    Ingeborg Astrid Sigrid Solveig Kirsten Mette Hanne Anneke Marieke Saskia Femke Maaike Liesbeth Annika Elin Freja Linnea Maja Ebba Aino Päivi Tuula Ritva
    Fatima Aisha Khadija Zainab Maryam Layla Leila Amina Yasmin Noor Salma Hala Samira Rania Zahra Parisa Shirin Ayşe Fatma Emine Zeynep Elif Hatice Merve Priya Anjali Lakshmi Sunita Deepa Kavita Pooja Meera Neha Aarti Divya Shreya Sushma Yuki Sakura Yoko Keiko Akiko Naoko Hiroko Mei Xiu Ling Hui Fang Thuy Ngoc Ngozi Amara Chiamaka Wanjiru Thandiwe
    Светлана Наталья Наталия Татьяна Ирина Екатерина Юлия Людмила Галина Надежда Любовь Марина Валентина Нина Виктория Александра Анастасия Ксения Дарья Полина Алина Вера Лариса Лидия Тамара Раиса Зинаида Софья София Маргарита Елизавета Вероника Кристина Евгения Оксана Инна Яна Жанна Алла Антонина Варвара Олеся Алёна Диана Олена Тетяна Наталія Ірина Юлія Катерина Оксана
    Αικατερίνη Κατερίνα Βασιλική Σοφία Άννα Γεωργία Ευαγγελία Δήμητρα Ειρήνη Ιωάννα Παναγιώτα Αγγελική Χριστίνα Κωνσταντίνα Αναστασία Ευτυχία Παρασκευή Φωτεινή Αλεξάνδρα Θεοδώρα Στυλιανή Χρυσούλα Ζωή Μαργαρίτα Νίκη Αθηνά Δέσποινα""".split()
)
MALE = tuple(
    """John Christopher Steven Paul Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack Dennis Jerry Tyler Aaron Adam Nathan Henry Douglas Zachary Peter Kyle Noah Ethan Jeremy Walter Keith Christian Roger Terry Austin Sean Gerald Carl Harold Dylan Arthur Lawrence
    Jesse Bryan Billy Bruce Gabriel Joe Logan Alan Juan Albert Willie Elijah Wayne Randy Vincent Philip Phillip Liam Mason Eugene Russell Roy Louis Bobby Johnny Bradley Ralph Alfred Allan Allen Alistair Angus Barry Bernard Bert Brendan Cecil Clarence Clifford Clive Colin Connor Craig Curtis Damian Darren Derek Desmond Donald Duncan Edgar Edmund Edwin Eliot Elliot Ernest Ernie Fred Frederick Geoffrey Geoff Gilbert Glenn Gordon
    Graham Harry Harvey Herbert Herman Howard Hugh Hugo Ian Isaac Ivan Ivor Jim Jimmy Joel Jonas Julian Ken Lee Leo Leon Leonard Leslie Lewis Lloyd Luke Malcolm Marcus Martin Maurice Max Melvin Mike Mitchell Neil Nigel Norman Oliver Oscar Oswald Owen Percy Ray Reginald Rex Rodney Rory Rupert Sam Sebastian Seth Sidney Simon Spencer Stanley Steve Stewart Stuart Ted Theodore Tim Toby Tom Tony Trevor Victor Wallace Warren Wesley Winston
    Hans Klaus Jürgen Heinz Karl Günter Günther Werner Horst Helmut Manfred Uwe Bernd Andreas Matthias Markus Christoph Florian Sebastian Tobias Jan Jens Jörg Kai Lars Lukas Moritz Niklas Olaf Oliver Otto Philipp Rainer Ralf Reinhard Rolf Rudolf Rüdiger Siegfried Sven Thorsten Torsten Ulrich Volker Walter Wilhelm Winfried Wolf Felix Finn Friedrich Fritz Georg Gerd Gerhard Gottfried Heiko Heinrich Henning Hermann Holger Ingo Joachim Jochen Johann Johannes Josef Konrad Kurt Ludwig Martin Maximilian Norbert Egon Erich Ernst Ewald Franz Alfons Alois Armin Arnold Axel Benedikt Bruno Burkhard Detlef Dirk Eberhard Eckhard
    Jean Pierre Jacques Michel André Alain Bernard Christophe Claude Daniel Denis Didier Éric Étienne Eugène Frédéric Gérard Gilles Grégoire Guillaume Guy Henri Hervé Hugues Jérôme Julien Laurent Louis Luc Lucien Marcel Mathieu Maxime Maurice Mathis Pascal Patrice Paul Raphaël Rémi René Romain Sébastien Serge Stéphane Sylvain Théo Thierry Vincent Xavier Yann Yves Antoine Arnaud Aurélien Baptiste Benoît Bertrand Cédric Charles Clément Damien Emmanuel Fabien Fabrice Gaston Émile
    Carlos Luis Juan Javier Miguel Ángel Alejandro Pedro Pablo Jorge Fernando Rafael Alberto Ramón Enrique Diego Vicente Raúl Sergio Jesús Jaime Andrés Joaquín Ignacio Eduardo Rubén Óscar Álvaro Adrián Iván Mario Roberto Ricardo Alfonso Salvador Emilio Julio Julián Tomás Gonzalo Guillermo Gustavo Héctor Hugo Arturo César Cristian Domingo Ernesto Esteban Felipe Félix Gabriel Germán Gerardo Gregorio Leonardo Lorenzo Marcos Martín Mateo Mauricio Nicolás Rodrigo Santiago Simón Víctor João Paulo Luiz Thiago Tiago Rui Nuno
    Giuseppe Giovanni Marco Andrea Luca Francesco Alessandro Matteo Stefano Paolo Luigi Angelo Carlo Domenico Enrico Fabio Filippo Franco Giacomo Giancarlo Giorgio Giulio Guido Massimo Mauro Michele Nicola Pietro Riccardo Salvatore Simone Tommaso Umberto Vincenzo Vittorio Claudio Dario Davide Emanuele Federico
    Jan Andrzej Piotr Krzysztof Stanisław Tomasz Paweł Józef Marcin Marek Michał Grzegorz Jerzy Tadeusz Adam Łukasz Zbigniew Ryszard Dariusz Henryk Mariusz Kazimierz Wojciech Robert Mateusz Rafał Jacek Janusz Maciej Sławomir Jarosław Kamil Wiesław Roman Jakub Vladimir Dmitri Dmitry Sergei Sergey Alexei Alexey Mikhail Nikolai Boris Igor Oleg Yuri Andrei Andrey Viktor Pavel Petr Jiří Tomáš Václav Zdeněk Miroslav Milan Zoran Dragan Goran Slobodan Nikola Bogdan Gheorghe Ion Mihai Radu István László Zoltán Gábor Ferenc Attila Sándor
    Erik Lars Anders Per Nils Olof Gunnar Sven Håkan Göran Björn Magnus Henrik Jens Søren Niels Mads Rasmus Kristian Ole Knut Bjørn Leif Rolf Tor Willem Pieter Cornelis Hendrik Johan Maarten Jeroen Joost Sander Bart Bram Daan Ruben Thijs Vincent Juha Matti Mikko Timo Kari Jukka Pekka Antti Heikki
    Mohammed Muhammad Mohamed Mohammad Ahmed Ahmad Ali Hassan Hussein Omar Umar Ibrahim Ismail Khalid Mustafa Mahmoud Youssef Yusuf Abdullah Abdul Tariq Karim Samir Rashid Said Reza Hamid Mehdi Mehmet Murat Hüseyin Emre Burak Osman Kemal Rahul Raj Rajesh Amit Sanjay Vijay Suresh Ramesh Anil Sunil Arjun Rohit Vikram Deepak Ashok Manoj Ravi Krishna Arun Hiroshi Kenji Takashi Akira Satoshi Kazuo Haruki Makoto Wei Jun Chen Ming Hao Jian Yong Xiao Minh Nguyen Tuan Kwame Kofi Chinedu Emeka Sipho Thabo David Moshe Avi Yitzhak Shlomo Ariel
    Александр Владимир Андрей Михаил Николай Евгений Виктор Юрий Павел Максим Игорь Олег Константин Василий Владислав Денис Антон Роман Никита Илья Кирилл Артём Артем Анатолий Борис Вадим Валерий Виталий Вячеслав Геннадий Георгий Григорий Даниил Егор Леонид Лев Пётр Петр Руслан Станислав Степан Тимур Фёдор Федор Эдуард Ярослав Семён Аркадий Богдан Глеб Захар Марк Матвей Тарас Олександр Володимир Микола Андрій Сергій Юрій Василь Михайло Дмитро
    Γεώργιος Δημήτρης Δημήτριος Κωνσταντίνος Κώστας Ιωάννης Γιάννης Νικόλαος Χρήστος Παναγιώτης Βασίλης Βασίλειος Αθανάσιος Θανάσης Μιχάλης Μιχαήλ Ευάγγελος Βαγγέλης Σπύρος Σπυρίδων Αντώνης Αντώνιος Ανδρέας Στέλιος Θεόδωρος Αλέξανδρος Ηλίας Σταύρος Πέτρος Σωτήρης Στέφανος Εμμανουήλ Μανώλης Απόστολος Φώτης Χαράλαμπος Λευτέρης Παύλος Θωμάς""".split()
)
#: Of either gender, or of one and the other in different languages.
NEUTRAL = frozenset("Andrea Jean Simone Robin Alex Kim Sasha Noel Morgan Taylor Jamie Quinn Rowan Jules Dana Ariel Casey Sidney Dominique Claude Michele Nicola Kari Yuki Саша Женя Валя Слава".split())
