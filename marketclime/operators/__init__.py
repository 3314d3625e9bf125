"""DataFrame to DataFrame operators. None collects data; exact quantiles write small tables on the way."""
