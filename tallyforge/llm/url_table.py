"""The small labelled URL table that the URL filter learns from: whole URLs by topic.

Wanted ones are public sites with paths as such sites have them; hosts of unwanted ones are made up in the ways
that such hosts are named.
"""

#: topic: wanted URLs.
WANTED = {
    "reference": """https://en.wikipedia.org/wiki/Alan_Turing https://de.wikipedia.org/wiki/Berlin https://fr.wikipedia.org/wiki/Paris https://es.wikipedia.org/wiki/Madrid
https://www.britannica.com/biography/Isaac-Newton https://www.wikidata.org/wiki/Q42 https://www.merriam-webster.com/dictionary/serendipity https://dictionary.cambridge.org/dictionary/english/river
https://www.gutenberg.org/ebooks/1342 https://archive.org/details/texts https://www.openstreetmap.org/node/240109189 https://www.wordreference.com/enfr/house https://www.duden.de/rechtschreibung/Haus
https://dle.rae.es/casa https://www.larousse.fr/dictionnaires/francais/maison https://plato.stanford.edu/entries/kant/ https://www.etymonline.com/word/bread https://commons.wikimedia.org/wiki/Main_Page""",
    "news": """https://www.bbc.co.uk/news/world-europe-66000000 https://www.nytimes.com/2023/05/01/science/space.html https://www.theguardian.com/environment/2022/oct/10/climate https://www.reuters.com/markets/europe/
https://www.lemonde.fr/international/article/2023/01/02/ https://www.spiegel.de/politik/deutschland/ https://elpais.com/economia/2023-03-04/ https://www.zeit.de/kultur/2022-08/buch https://apnews.com/article/weather-storm-abc123
https://www.washingtonpost.com/opinions/2021/07/04/ https://www.economist.com/finance-and-economics/2023/06/01/ https://www.lefigaro.fr/vox/societe https://www.elmundo.es/cultura/literatura.html https://www.faz.net/aktuell/wissen/
https://www.npr.org/sections/health/2020/04/ https://www.aljazeera.com/news/2023/2/6/earthquake https://www.sueddeutsche.de/sport/fussball https://www.dw.com/en/top-stories/s-9097 https://www.liberation.fr/planete/""",
    "science": """https://arxiv.org/abs/1706.03762 https://www.nature.com/articles/s41586-020-2649-2 https://www.nasa.gov/mission_pages/station/main https://www.esa.int/Science_Exploration/Space_Science https://home.cern/science/accelerators
https://www.who.int/news-room/fact-sheets/detail/malaria https://pubmed.ncbi.nlm.nih.gov/12345678/ https://www.science.org/doi/10.1126/science.abc https://journals.plos.org/plosone/article https://www.pnas.org/content/118/1
https://www.noaa.gov/weather https://www.usgs.gov/programs/earthquake-hazards https://www.cdc.gov/flu/about/index.html https://www.mpg.de/forschung https://www.cnrs.fr/fr/actualite https://www.royalsociety.org/journals/
https://www.ipcc.ch/report/ar6/syr/ https://www.kew.org/read-and-watch/plants https://www.nhm.ac.uk/discover/dinosaurs.html https://biorxiv.org/content/10.1101/2020""",
    "code": """https://github.com/apache/spark/pull/1 https://gitlab.com/gitlab-org/gitlab https://stackoverflow.com/questions/11227809/why-is-processing https://docs.python.org/3/library/itertools.html https://www.rust-lang.org/learn
https://spark.apache.org/docs/latest/sql-programming-guide.html https://numpy.org/doc/stable/user/ https://pypi.org/project/requests/ https://developer.mozilla.org/en-US/docs/Web/HTML https://www.kernel.org/doc/html/latest/
https://golang.org/pkg/net/http/ https://www.postgresql.org/docs/current/queries.html https://kubernetes.io/docs/concepts/ https://www.freebsd.org/doc/handbook/ https://www.w3.org/TR/html52/ https://cran.r-project.org/web/packages/
https://bugs.debian.org/cgi-bin/bugreport.cgi https://doc.qt.io/qt-6/ https://www.sqlite.org/lang_select.html https://sourceforge.net/projects/ https://pandas.pydata.org/docs/reference/""",
    "public": """https://www.gov.uk/browse/driving https://www.europa.eu/european-union/index_en https://www.bundestag.de/dokumente https://www.senat.fr/rap/ https://www.whitehouse.gov/briefing-room/ https://www.congress.gov/bill/117th-congress
https://www.un.org/en/about-us https://www.worldbank.org/en/country https://www.imf.org/en/Publications https://www.oecd.org/education/ https://www.boe.es/diario_boe/ https://www.service-public.fr/particuliers https://www.berlin.de/buergeramt/
https://www.irs.gov/forms-instructions https://www.census.gov/data/tables.html https://www.loc.gov/collections/ https://www.stadt-zuerich.ch/portal/de https://www.ecb.europa.eu/stats/ https://www.nationalarchives.gov.uk/education/""",
    "schools": """https://www.mit.edu/research/ https://www.stanford.edu/list/academic/ https://www.ox.ac.uk/admissions/undergraduate https://www.ethz.ch/en/studies.html https://www.tu-berlin.de/studieren https://www.sorbonne-universite.fr/formation
https://www.uni-heidelberg.de/de/bibliothek https://www.ucm.es/estudios https://www.khanacademy.org/math/algebra https://ocw.mit.edu/courses/mathematics/ https://www.coursera.org/learn/machine-learning https://www.harvard.edu/about/
https://www.upf.edu/web/graus https://www.polytechnique.edu/recherche https://www.cs.cmu.edu/people/ https://www.open.ac.uk/courses https://www.uni-wien.ac.at/lehre https://www.tum.de/studium/""",
    "shops": """https://www.amazon.com/dp/B08N5WRWNW https://www.ikea.com/us/en/cat/chairs/ https://www.bestbuy.com/site/laptops https://www.etsy.com/listing/123456 https://www.ebay.de/itm/987654 https://www.otto.de/moebel/ https://www.fnac.com/livre
https://www.waterstones.com/category/history https://www.decathlon.es/es/deportes https://www.rei.com/c/tents https://www.thalia.de/buecher https://www.coca-cola.com/brands https://www.rolls-royce.com/products https://www.lego.com/themes
https://www.bosch-home.com/kitchen https://www.carrefour.fr/rayons https://www.mercadona.es/es/tiendas https://www.marksandspencer.com/l/women https://www.toyota.com/trucks/""",
    "travel": """https://www.lonelyplanet.com/italy/rome https://www.sncf.com/fr/offres https://www.bahn.de/fahrplan https://www.renfe.com/es/viajes https://www.lufthansa.com/flights https://www.airfrance.fr/vols https://www.nps.gov/yell/index.htm
https://www.visitnorway.com/places-to-go https://www.booking.com/hotel/it/ https://www.tripadvisor.com/Attractions https://www.louvre.fr/en/explore https://www.museodelprado.es/coleccion https://www.metmuseum.org/art/collection https://www.britishmuseum.org/visit
https://www.alpenverein.de/huetten https://www.nationaltrust.org.uk/visit/garden https://www.hiking-trails.ch/route/""",
    "home": """https://www.allrecipes.com/recipe/apple-pie/ https://www.chefkoch.de/rezepte/kartoffelsuppe.html https://www.marmiton.org/recettes/quiche https://www.seriouseats.com/bread https://www.bbcgoodfood.com/recipes/soup https://www.gardenersworld.com/plants/rose
https://cooking.nytimes.com/recipes/ https://www.weather.com/forecast/today https://www.meteofrance.com/previsions https://www.wetter.de/vorhersage https://www.imdb.com/title/tt0111161/ https://www.goodreads.com/book/show/1 https://www.chess.com/learn
https://www.uefa.com/uefachampionsleague/ https://www.fifa.com/tournaments https://www.cyclingnews.com/races/ https://www.runnersworld.com/training https://www.discogs.com/artist/ https://www.mayoclinic.org/diseases-conditions/ https://www.nhs.uk/conditions/asthma/""",
    "people": """https://medium.com/@writer/thinking-slowly https://blog.thornbury.net/2019/05/notes https://mornington.wordpress.com/2014/11/02/autumn/ https://harbourlight.blogspot.com/2012/01/tide.html https://www.stonebridge-parish.org/choir https://theresa.example.com/en/99
https://www.oldmillpottery.co.uk/about https://m.heathershore.org/fr/12 https://blog.thistledown.net/en/4/ https://reinhardt-schreinerei.de/werkstatt https://www.boulangerie-moreau.fr/horaires https://www.ferreteria-sanchez.es/contacto http://thander.org/en/8.html
https://www.whitstable-sailing.org/club https://tionette.net/de/3 https://www.entrish.com/es/55 http://m.andthorne.org/en/71/ https://blog.shenstone.com/en/16 https://www.readingroom.org/index.html http://hethering.net/fr/7.html https://ingthorpe.org/de/31 http://www.onderby.com/en/2/""",
    "places": """http://www.ashbourne.example.com/en/14 https://blog.trentham.example.net/en/208 https://m.northleach.example.org/fr/33/ http://thaxted.example.net/de/71.html https://www.hathersage.example.org/es/5 https://wherwell.example.com/en/930
http://blog.oundle.example.net/fr/61 https://m.tintern.example.net/es/480 https://ingatestone.example.org/en/19 http://www.edenbridge.example.net/en/77 https://lyndhurst.example.com/de/300 https://www.alresford.example.net/fr/12/
http://m.netherton.example.com/en/8 https://blog.reith.example.org/en/640.html https://shanklin.example.net/en/55 https://www.heathfield.example.net/es/204 http://tionville.example.net/de/18 https://stanton.example.net/en/91 https://blog.thirsk.example.net/en/3
https://m.whitby.net/de/44 https://www.tenterden.net/es/9 http://blog.ledbury.net/en/150 https://arundel.net/fr/28/ https://hinton.net/en/67 http://www.rye-harbour.org/en/6 https://mittenwald.net/de/2 https://www.sankt-goar.de/de/75 https://saint-malo.net/fr/40
https://santander.net/es/88 https://www.alcala-real.org/es/16 https://m.honfleur.org/fr/9.html http://blog.konstanz.org/de/51 https://www.bad-urach.net/de/14 https://ronda.com/es/7 https://theale.com/en/110 http://www.ringstead.com/fr/23 https://otterton.org/en/72
https://thatcham.example.net/en/35 http://m.ethie.example.net/en/12/ https://blog.inverness.example.net/es/260 https://www.andover.example.org/en/5 https://redruth.example.com/fr/318 https://blog.shere.example.com/en/42 https://www.leatherhead.example.com/de/64
https://erith.org/es/3 http://www.tring.net/en/29 https://m.thame.com/en/58 https://heathrow.net/es/10 https://ottery.net/fr/6 http://www.hartland.org/en/81""",
    "near": """https://www.essex.gov.uk/schools https://www.sussex.ac.uk/library https://www.winchester.ac.uk/study https://www.freecodecamp.org/learn/ https://www.bestwestern.com/hotels https://www.cancer.gov/types/breast https://www.pharmacy.umaryland.edu/academics
https://www.adult-education.org/courses https://www.middlesex.org/parks https://www.cashmere-weavers.co.uk/shop https://www.fsf.org/free-software https://www.freelibrary.org/branches https://www.win-rar-museum.org/history https://www.betterhealth.vic.gov.au/diet
https://www.alphabet.com/investor https://www.spamalot-musical.com/tickets https://www.crackershome.org/recipes https://www.creditunion.coop/about https://www.loanwords.org/linguistics https://www.watchmakers.ch/atelier https://www.secure-software.org/papers
https://home.cern/news https://zoom.us/meetings https://nodejs.org/api/ https://kde.org/products https://matrix.org/docs https://lichess.org/study https://www.w3.org/Style/ https://curl.se/docs https://vuejs.org/guide https://xkcd.com/353/ https://dot.net/docs""",
}

#: topic: unwanted URLs.
UNWANTED = {
    "gambling": """http://best-casino-bonus.top/claim http://casino-royal-slots.xyz/free-spins http://www.lucky-poker24.win/register http://online-slots-jackpot.bid/play-now http://bet365-mirror.icu/bonus http://sport-bets-tips.club/en/12
http://free-roulette-online.info/win http://mega-casino.example.net/fr/5 http://www.casino-vip.org/es/3 http://topbetting-odds.click/signup http://blackjack-win-big.xyz/deposit http://m.pokerstars-hack.top/chips http://sure-bets.org/en/77 http://fastbets.net/de/9
http://golden-jackpot-slots.buzz/spin http://casinos-online.com/en/4 http://livebet-asia.vip/agen http://judi-slot-gacor.xyz/daftar http://betwin.org/en/10/""",
    "pharma": """http://cheap-viagra-online.top/buy http://cialis-generic-pills.xyz/order-now http://www.pills-no-prescription.biz/cart http://discount-meds24.icu/cheap http://buy-tramadol-overnight.click/usa http://canadian-pharmacy-rx.info/viagra
http://best-pills.org/en/8 http://pharma-cheap.net/fr/22 http://levitra-cheap.bid/discount http://diet-pills-online.com/en/3 http://mypills.net/de/40 http://generic-meds-cheap.club/checkout http://www.xanax-cheap.xyz/buy-online http://pills-market.org/es/6
http://steroids-buy-cheap.top/order http://cheap-meds.com/en/18 http://rx-pills-shop.win/sale""",
    "adult": """http://free-porn-videos.xxx/watch http://hot-sex-cams.top/live http://www.xxx-tube-hd.xyz/free http://adult-webcams-live.click/join http://sexy-singles-tonight.club/chat http://escort-girls-cheap.icu/vip http://nude-teens-pics.bid/gallery
http://adult-video.org/en/5 http://adults-only.net/fr/11 http://xxx-pics.com/en/2 http://hotgirls-cam.win/free http://porn-hd-stream.buzz/watch http://adult-dating-near-me.xyz/signup http://sex-hookup.example.org/de/6 http://camgirls-x.net/en/29 http://milf-x.com/es/9
http://adultcams.net/en/13""",
    "loans": """http://payday-loans-fast.top/apply http://quick-cash-loan24.xyz/no-credit-check http://instant-loan-approval.loan/apply-now http://bad-credit-loans.bid/cash http://www.cheap-insurance-quotes.icu/free-quote http://debt-relief-now.click/start http://cash-advance-online.club/apply
http://easy-loans.org/en/4 http://fast-cash.net/fr/8 http://credit-repair-fix.win/offer http://loan-win.com/en/15 http://forex-signals-profit.xyz/join http://binary-options-rich.top/profit http://crypto-doubler-btc.icu/invest http://free-bitcoin-generator.xyz/claim
http://get-rich-quick.buzz/money http://earn-money-home.info/secret""",
    "warez": """http://crack-keygen-download.top/serial http://free-warez-full.xyz/download http://www.windows-activator-crack.icu/get http://nulled-scripts-free.club/download-now http://torrent-movies-hd.click/free http://game-hack-cheats.win/generator http://serial-keys-free.bid/office
http://full-crack.org/en/7 http://crackz.net/de/3 http://free-keygen.com/en/21 http://mod-apk-unlimited.xyz/download http://hacktool-free.buzz/setup.exe http://driver-update-free.top/install.exe http://adobe-crack-free.info/patch http://cracked-apps.org/es/2 http://malware-x.net/fr/5
http://virus-alert-fix.click/scan""",
    "links": """http://spam-link-farm.top/backlinks http://buy-backlinks-cheap.xyz/seo http://www.seo-rank-boost.icu/order http://article-spinner-free.club/spam http://guest-post-links.bid/cheap http://linkfarm.org/en/3 http://spam-mailer.net/fr/9 http://spamdirectory.com/en/6
http://free-traffic-bot.win/hits http://instant-followers-likes.click/buy http://buy-followers-cheap.xyz/instagram http://spammy.org/de/14 http://mass-email-spam.info/list http://spam-x.com/es/8 http://bulk-links.net/en/17 http://link-spam.org/en/44 http://seo-spam-links.net/en/2""",
    "prizes": """http://free-iphone-winner.top/claim http://you-won-gift-card.xyz/prize http://www.win-free-prizes.icu/survey http://amazon-giveaway-free.club/claim-now http://lottery-winner-claim.bid/prize http://lucky-draw-win.click/spin http://free-gift-cards24.win/generator
http://sweepstakes-win.org/en/6 http://win-prize.net/es/4 http://free-win.com/en/19 http://claim-reward-now.buzz/free http://survey-rewards-cash.xyz/start http://congratulations-winner.top/lucky http://freebies-win.org/fr/13 http://prize-farm.net/en/23""",
    "replicas": """http://replica-watches-cheap.top/rolex http://cheap-louis-bags.xyz/outlet http://www.fake-designer-shoes.icu/sale http://cheap-jerseys-wholesale.club/nfl http://outlet-handbags-discount.bid/90-off http://cheap-sneakers-outlet.click/sale http://best-replica.org/en/9
http://cheap-replica.net/de/5 http://ugg-boots-cheap.win/outlet http://luxury-replica.com/en/31 http://cheap-sunglasses-outlet.xyz/buy http://discount-outlet-sale.top/cheap http://cheap-x.org/fr/2 http://replica-farm.net/es/12 http://cheap-vapes.com/en/7""",
    "phishing": """http://paypal-account-verify.top/login http://secure-login-bank-update.xyz/verify http://www.apple-id-locked.icu/confirm http://account-suspended-alert.club/signin http://netflix-billing-update.click/login.php http://verify-wallet-connect.bid/unlock
http://microsoft-support-alert.win/call http://bank-secure-verify.info/update/login.php http://dhl-parcel-fee.buzz/pay http://metamask-verify.xyz/seed http://login-verify.org/en/5 http://account-update.net/fr/3 http://ebay-signin-secure.top/confirm http://irs-refund-claim.icu/form""",
    "miracles": """http://lose-weight-fast-keto.top/buy http://miracle-diet-secret.xyz/free-trial http://www.belly-fat-burner.icu/order http://anti-aging-miracle.club/trial http://hair-growth-miracle.bid/buy-now http://one-weird-trick.click/secret http://detox-slim-tea.win/offer
http://miracle-cure.org/en/8 http://best-diet.net/de/7 http://slim-fast-now.com/en/26 http://testosterone-boost.xyz/free-bottle http://keto-gummies-cheap.buzz/sale http://brain-pills-genius.top/trial http://psychic-readings-free.info/chat http://miracle-x.net/es/3""",
    "plain": """http://www.poker-win.example.com/en/12 https://cheap-viagra.example.org/de/406 http://m.free-porn.example.net/es/71#top https://blog.spam-links.example.org/en/9 https://casino-bonus.example.net/fr/33.html http://bets-online.example.com/en/508/
https://www.pills-shop.example.net/en/250 http://adult-cams.example.org/en/61 https://m.slots-casino.example.com/de/18 http://free-slots.example.org/fr/640 https://cheap-meds.example.net/en/87.html http://www.spam-mails.example.com/es/2 https://adults-x.example.com/en/330
http://best-bets.example.net/en/45 https://blog.pill-farm.example.org/de/7/ http://sports-bets.example.org/es/119 https://www.casinos.example.org/en/702 http://m.xxx-adult.example.com/fr/58 https://cheap-replica.example.com/en/14 http://win-casino.example.net/de/90
https://spam-x.example.com/en/22 http://www.link-farm.example.net/fr/8 https://free-pills.example.com/en/377 http://track-ads.example.com/en/64 https://www.ads-click.example.net/de/3 http://m.ad-tracker.example.org/en/51 http://ads-pixel.example.com/es/20 https://track-click.example.org/fr/4""",
    "trackers": """http://ads-server24.top/click http://pixel-track.xyz/imp http://www.popup-ads.click/redirect http://ad-clicks.bid/track http://adserve-track.net/en/4 http://trackads.org/fr/2 http://banner-ads.info/click http://clicktrack-ads.com/en/9 http://ads-popunder.icu/serve http://push-ads.buzz/subscribe""",
}


def urls(table: dict[str, str], topics: "list[str] | None" = None) -> list[str]:
    """The URLs of some topics (all by default)."""
    return [u for t in table if topics is None or t in topics for u in table[t].split()]
