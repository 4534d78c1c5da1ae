"""python -m grafloom"""


def main() -> None:
    print("Hello!")


if __name__ == "__main__":
    main()
