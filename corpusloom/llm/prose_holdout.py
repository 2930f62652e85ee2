"""Hand-checked texts: running prose, and what isn't. All are invented."""

PROSE = [
    "Вчера вечером мы долго сидели у реки, и никто не хотел идти домой. Потом пошёл дождь, а зонт был только один.",
    "не знаю как у вас а у нас опять отключили воду, говорят до понедельника. хорошо хоть свет есть и интернет пока работает",
    "МЫ СОБРАЛИ ПОДПИСИ И ОТНЕСЛИ ИХ В УПРАВУ, НО ТАМ СКАЗАЛИ, ЧТО НАДО ПОДОЖДАТЬ ДО ОСЕНИ. ЖДЁМ УЖЕ ВТОРОЙ ГОД.",
    "— Ты придёшь завтра?\n— Не думаю, у меня ещё работа.\n— Тогда я позвоню Ольге, и мы решим без тебя.\n— Ладно, так и сделаем.",
    "В работе показано, что при нагревании образцов их прочность снижается. Это связано с тем, что зёрна растут быстрее, чем на холоде.",
    "Вопрос: Как обновить драйвер, если система его не видит?\nОтвет: Сначала удалите старый, потом перезагрузите машину. После этого поставьте новый и проверьте, что он работает.",
    "The ferry was late again, so we waited at the pier and talked about the old days. When it came, it was almost dark.",
    "i dont get why they changed it, the old one was fine and everybody knew how to use it. now even my boss is lost",
    "Отель понравился, но до моря идти дольше, чем писали на сайте. Персонал вежливый, завтраки простые, зато из окна видно горы.\nОценка: 4 из 5.",
    "Аннотация. Рассмотрена задача о движении тела по наклонной плоскости при наличии трения. Решение получено в явном виде, и оно хорошо согласуется с опытом.",
    "Для пирога нам понадобится:\n- мука\n- сахар\n- два яйца\nСмешайте всё в миске и оставьте на полчаса, чтобы тесто отдохнуло. Потом выпекайте, пока корочка не станет золотой, и подавайте тёплым, потому что так он вкуснее всего.",
    "Поезд шёл на север. За окном были поля, потом лес, потом снова поля, и казалось, что так будет всегда.",
    "Мне кажется, что эта книга лучше, чем первая: в ней меньше описаний, но больше жизни. Хотя конец, конечно, предсказуем.",
    "КРАСНОГОРСК, 3 марта. Депутаты приняли бюджет в первом чтении, однако ко второму его ещё могут изменить. Об этом сообщили в пресс-службе.",
    "Although the samples were small, the effect was clear in both groups. We therefore think that the method can be used in the field as well.",
    "да все нормально он просто устал с дороги и хочет спать а завтра сам тебе позвонит и все расскажет не переживай так",
    "Сервер упал ночью, потому что закончилось место на диске. Мы почистили журналы, и утром всё уже работало, но причину так и не нашли.",
    "Если верить календарю, весна уже пришла. Но снег лежит, как лежал, и дворники не успевают его убирать.",
]
JUNK = [
    "Молоко\nХлеб\nСыр твёрдый\nМасло\nЯблоки зелёные\nКрупа\nЧай",
    "* болты М6\n* гайки М6\n* шайбы\n* ключ на десять\n* смазка",
    "12;34,5;ООО Ромашка;7788\n13;35,1;ООО Лютик;7791\n14;36,0;ИП Петров;7802",
    "| год | доход | расход |\n|---|---|---|\n| 2019 | 120,4 | 98,1 |\n| 2020 | 118,0 | 99,7 |\n| 2021 | 131,9 | 104,2 |",
    "Главная » Каталог » Обувь » Сапоги » Зимние » Назад » Далее » Корзина » Вход » О нас » Контакты",
    "2024-02-11 10:22:01 INFO start id=77\n2024-02-11 10:22:03 WARN slow rc=12\n2024-02-11 10:22:09 ERROR stop rc=1",
    "Иванов А. Б. Основы сварки. М.: Наука, 1988. С. 12–40.\nПетров В. Г. Сплавы // Вестник. 2001. Т. 3, № 4. С. 5–19.\nСидоров Д. Е. Литьё // Труды. 1999. Т. 8, № 1. С. 77–81.",
    "фывафыва олджолдж фывпролд джлорпа выфавыфа лоролдж фыва олдж вапролд",
    "asdfasdf lkjh;lkj asdf; lkjhg fdsa;lkj asdfgh lkjhlkj asdf hjkl;",
    "Ð\x9fÑ\x80Ð¸Ð²ÐµÑ\x82 Ð¼Ð¸Ñ\x80 Ð¸ Ð²Ñ\x81ÐµÐ¼ Ñ\x85Ð¾Ñ\x80Ð¾Ñ\x88ÐµÐ³Ð¾ Ð´Ð½Ñ\x8f",
    "РџСЂРёРІРµС‚ РјРёСЂ, СЃРµРіРѕРґРЅСЏ С…РѕСЂРѕС€РёР№ РґРµРЅСЊ, РїРѕС‚РѕРјСѓ С‡С‚Рѕ РЅРµС‚ РґРѕР¶РґСЏ",
    "Ñåãîäíÿ õîðîøàÿ ïîãîäà, è ìû èä¸ì ãóëÿòü ïî ãîðîäó.",
    "купить окна недорого купить окна недорого купить окна недорого купить окна недорого купить окна недорого купить окна недорого",
    "==== ##%% 7f3a9c {}[]<> 99$$ \\\\// ~~~~ 0x1f 0x2e a8f7c6 }}{{ **&& 55%%",
    "диваны угловые, кресла офисные, столы письменные, шкафы книжные, лампы настольные, полки настенные, тумбы, вешалки",
    "for (i = 0; i < n; i++) { a[i] = b[i] * c; }\nif (x == NULL) { return -1; }\nint main(void) { return 0; }",
    "apples\t3\t1.20\npears\t5\t2.45\nplums\t9\t0.80\nfigs\t1\t3.10",
    "Home | Products | Support | About | Login | Cart | Home | News | Contacts | Search",
]
